"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, keep_one, signature, squeezed, text_or_empty

PREFIX_CHARS = 64


def hashed_rows(docs: DataFrame, id_col: str, text_col: str, digest: bool, *more: Column) -> DataFrame:
    """(id, chars, key [, text_sha256], more): one row per row of ``docs``, cut.

    ``key`` is the SHA-256 of the squeezed text of rows that share length and prefix with another, null for rows that
    are alone.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), *more).withColumn("n", squeezed(F.col("t")))
    size, prefix = F.length("n").alias("size"), F.xxhash64(F.substring("n", 1, PREFIX_CHARS)).alias("prefix")
    seen = rows.select(size, prefix).groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("c"))
    lengths = seen.groupBy("size").agg(F.sum("c").alias("c")).where("c > 1").select("size")
    live = cut(seen.join(lengths, "size", "left_semi").where("c > 1").select("size", "prefix", F.lit(True).alias("live")))

    full, names = F.sha2(F.col("n"), 256), [c for c in rows.columns if c not in ("id", "t", "n")]
    read = rows.select("id", F.length("t").alias("chars"), size, prefix, full.alias("text_sha256") if digest else F.col("n"), *names)
    read = read.join(F.broadcast(live) if bounded(live) else live, ["size", "prefix"], "left")
    key = F.when(F.col("live"), F.col("text_sha256") if digest else full)
    return cut(read.select("id", "chars", key.alias("key"), *(["text_sha256"] if digest else []), *names))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept [, text_sha256].

    Texts are equal when they are the same after deleting ASCII white space.  Of equal
    texts the one with the most code points, then the smallest id, stays.

    1. One scan gives every row's squeezed length and the hash of its first characters;
       both are counted together (map-side first, so one value held by a third of all
       rows is one row per task), lengths that occur once go, then prefixes that do.
    2. A second scan takes the SHA-256 of the whole text for rows of the surviving
       (length, prefix) pairs only.  The surviving pairs are broadcast if there are few
       enough; otherwise they meet the rows by a shuffle, in which a hot pair can be split.
    3. Equal hashes are counted and joined back; a hot group is split by the
       adaptive skew join as its rows are independent.

    ``digest`` adds the hash for all rows, as a column of the result; thin rows then meet the pairs.

    Null text counts as empty.  A null id is larger than any other id.  Rows that repeat
    an id and a text each count in group_size and share one decision.  Empty tables give
    empty results; other columns are ignored.
    """
    hashed = hashed_rows(docs, id_col, text_col, digest)
    # a row that is alone gets a key of its own, lest all of them meet under one null
    alone = F.concat(F.lit("id:"), F.coalesce(F.col("id").cast("string"), F.col("chars").cast("string")))
    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"))).alias("best")
    groups = hashed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), best)
    # cut, so that the join has an exchange of its own on either side and can split a hot group
    groups = cut(groups.where("group_size > 1").select("key", "group_size", F.col("best.id").alias("keep_id"), F.lit(True).alias("grouped")))
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id"))
    return hashed.withColumn("key", F.coalesce("key", alone)).join(groups, "key", "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), *(["text_sha256"] if digest else []),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (see ``exact_groups``), and nothing else missing.

    Rows are judged one by one, not by id: of a group the row with the most code points stays, then the
    smallest id, null ids last, then the smallest hash of the original text; of rows that repeat both id and text, any one.
    Rows of other texts stay though they share an id with a copy, or have none.  Null text counts as
    empty, and is a copy of other empty texts.  All columns pass through; an empty table stays one.
    """
    marked = hashed_rows(docs, id_col, text_col, False, *signature(id_col, text_col)[1:]).where("key IS NOT NULL").withColumnRenamed("id", "__i")
    return keep_one(docs, marked, "key", [(-F.col("chars")).alias("fewer")], id_col, text_col)
