"""Mixing sources to target weights by temperature, in DataFrame operations only.

Token shares p of the sources become weights proportional to p^a.  The exponent a is found by
bisection: the largest one in [0, 1] whose weights have the entropy asked for, then, if a source
would be read more often than the repetition limit, the least one that is within it.  The weights
are realised as a token stream per source - one permutation of its documents after the other - of which every
block of the mixture takes its budgeted part.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, text_or_empty

#: Bisection steps of one pass over the source totals, and passes: 30 steps in all.
LEVELS, PASSES = 6, 5
#: Documents of a permutation slot, and slots of a slot group: what one window sorts.
SLOT_DOCS, GROUP_SLOTS = 512, 1024


@dataclass(frozen=True)
class Mixture:
    """entropy: share of the largest possible; repetition: permutations of a source, at most.

    budget: tokens of the mixture, by default as many as there are; ``cover`` takes the least
    budget with which every document of every source is read at least once.
    """

    entropy: float = 0.95
    repetition: float = 4.0
    budget: int | None = None
    cover: bool = False
    blocks: int = 64
    seed: int = 42


def token_count(text: Column) -> Column:
    """Words; a document without any counts as one, so that it is placed too."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(1)).cast("long")


def source_key(name: str) -> Column:
    """A key without nulls: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("-"))


def bisect(shares: DataFrame, value, wanted: float, rising: bool) -> float:
    """The exponent in [0, 1] at which ``value`` (of p and a, over all sources) crosses ``wanted``.

    A pass evaluates all exponents that its next ``LEVELS`` bisection steps can visit, by one
    aggregation over the source table; only those numbers come to the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << LEVELS
        tried = [low + (high - low) * i / n for i in range(n + 1)]
        rows = shares.select("p", F.posexplode(F.array(*map(F.lit, tried))).alias("i", "a"))
        at = {r.i: r.x for r in value(rows.groupBy("i")).collect()}
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            beyond = at[middle] >= wanted if rising else at[middle] <= wanted
            a, b = (a, middle) if beyond else (middle, b)
        low, high = tried[a], tried[b]
    return high if rising else low


def entropy(groups) -> DataFrame:
    z, m = F.sum(F.pow("p", "a")), F.sum(F.pow("p", "a") * F.log("p"))
    return groups.agg((F.log(z) - F.first("a") * m / z).alias("x"))


def weights(sources: DataFrame, mix: Mixture) -> tuple[DataFrame, int]:
    """(source, docs, tokens, share, weight, quota) and the budget; ``sources`` has source, docs and tokens."""
    total, many, least, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not many:
        return sources.select("*", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota")), 0
    shares = sources.select((F.col("tokens") / F.lit(total)).alias("p"))
    exponent = 1.0
    if many > 1 and least < most:
        goal = mix.entropy * log(many)
        natural = shares.agg(-F.sum(F.col("p") * F.log("p"))).first()[0]
        if natural < goal:
            # entropy falls as the exponent rises: keep the side that still meets the goal
            exponent = bisect(shares, entropy, goal, rising=False)
        scale = (mix.budget or total) / total

        def repeated(groups) -> DataFrame:
            z = F.sum(F.pow("p", "a"))
            # weight / share is largest for the smallest source, as a is at most 1
            ratio = F.max(F.pow("p", F.col("a") - 1))
            cover = ratio / F.min(F.pow("p", F.col("a") - 1))
            return groups.agg((-(cover if mix.cover else ratio / z * scale)).alias("x"))

        now = -repeated(shares.select("p", F.lit(exponent).alias("a"), F.lit(0).alias("i")).groupBy("i")).first().x
        if now > mix.repetition:
            exponent = bisect(shares, repeated, -mix.repetition, rising=True)
    z = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    weighed = sources.withColumn("share", F.col("tokens") / F.lit(total)).withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
    budget = mix.budget or total
    if mix.cover:
        budget = int(total * weighed.agg(F.max(F.col("share") / F.col("weight"))).first()[0]) + 1
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    return weighed.withColumn("quota", F.greatest(quota, F.col("tokens")) if mix.cover else quota), budget


def plan(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per reading of a document: source, id, doc (hash of the text), tokens, copies, epoch, start, block, place.

    ``start`` is the token position of the document in its source's stream, ``block`` the block of the mixture
    that it falls into, ``place`` a random order within the block.  A stream ends with the document in which the
    source's quota ends.

    Prefix sums are taken in slots of hashed order: about ``SLOT_DOCS`` documents meet in a task whatever
    the size of a source, then slot totals, then totals of slot groups.

    Rows that repeat source, id and text are one reading with ``copies``; other texts of the id are documents of their own.  Null text counts as
    empty, a null source is a source, a null id is an id.  An empty table gives an empty plan.
    """
    seen = docs.select(source_key(source_col).alias("key"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("doc"), token_count(text_or_empty(text_col)).alias("tokens"))
    seen = cut(seen.groupBy("key", "source", "id", "doc", "tokens").agg(F.count(F.lit(1)).alias("copies")))
    sources = cut(seen.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")))
    weighed, _ = weights(sources, mix)
    weighed = weighed.select("key", "docs", F.col("tokens").alias("size"), "quota")
    # bits of a hash that make slots of SLOT_DOCS documents
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(float(SLOT_DOCS))))).cast("int")
    weighed = cut(weighed.where("quota > 0"))
    rows = seen.join(F.broadcast(weighed) if bounded(weighed) else weighed, "key").withColumn("bits", bits)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div size"))))
    order = F.xxhash64("key", "id", "doc", "epoch", F.lit(mix.seed))
    rows = rows.withColumn("order", order).withColumn("slot", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(order, 64 - bits)")))
    rows = rows.withColumn("load", F.col("tokens") * F.col("copies"))

    slots = rows.groupBy("key", "epoch", "slot").agg(F.sum("load").alias("load")).withColumn("group", F.expr(f"slot div {GROUP_SLOTS}"))
    before = F.coalesce(F.sum("load").over(Window.partitionBy("key", "epoch", "group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("in_group", before)
    groups = slots.groupBy("key", "epoch", "group").agg(F.sum("load").alias("load"))
    before = F.coalesce(F.sum("load").over(Window.partitionBy("key", "epoch").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.join(groups.select("key", "epoch", "group", before.alias("ahead")), ["key", "epoch", "group"]).select("key", "epoch", "slot", (F.col("in_group") + F.col("ahead")).alias("ahead"))

    within = Window.partitionBy("key", "epoch", "slot").orderBy("order", "id", "doc").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("load").over(within), F.lit(0))).join(slots, ["key", "epoch", "slot"])
    start = F.col("epoch") * F.col("size") + F.col("ahead") + F.col("within")
    rows = rows.withColumn("start", start).where("start < quota")
    block = F.floor(F.col("start").cast("double") * F.lit(mix.blocks) / F.col("quota")).cast("int")
    place = F.xxhash64("key", "id", "doc", "epoch", F.lit(mix.seed + 1))
    return rows.select("source", "id", "doc", "tokens", "copies", "epoch", "start", F.least(block, F.lit(mix.blocks - 1)).alias("block"), place.alias("place"))


def mixed(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as the plan reads them: each as often as it has epochs, with its columns only.

    Texts move once, to meet their readings by id and the hash of the text; a hot source is no hot key.  Rows that repeat source, id and
    text are read alike.  Null text counts as empty, a null source is a source, a null id is an id; columns pass
    through, and an empty table stays one.
    """
    names = docs.columns
    readings = plan(docs, mix, id_col, text_col, source_col).groupBy("source", "id", "doc").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    readings = readings.select(F.col("source").alias("__s"), F.col("id").alias("__i"), F.col("doc").alias("__d"), "__times")
    own = docs.withColumn("__n", F.xxhash64(text_or_empty(text_col)))
    met = own.join(readings, own[id_col].eqNullSafe(F.col("__i")) & own[source_col].eqNullSafe(F.col("__s")) & (own["__n"] == F.col("__d")))
    return met.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
