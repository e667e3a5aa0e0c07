"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import cut, id_fold, in_batches

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the stems of a word: insults of a language share stems, some of which harmless words share too.
SHORTEST, LONGEST = 4, 9
#: Chi-square of a stem with the label over the examples, from which it is a term of the index.
CHI_SQUARE = 24.0
#: Fewer examples make no term.
RARE = 5
BLOCK = 64
NEIGHBOURS = 15
#: Labelled rows of each class that are read as examples, at most: the bound of the index.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 1000, 3000
#: Tasks that the bounded examples are dealt to.
EXAMPLE_TASKS = 24


def stems(text: str, known: dict | None = None) -> Counter:
    """Stem counts of a whole text; only those of ``known`` if it is given."""
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for size in range(min(SHORTEST, len(word)), min(LONGEST, len(word)) + 1):
            stem = word[:size]
            if known is None or stem in known:
                counts[stem] += n
    return counts


@dataclass
class ToxicIndex:
    """Unit TF-IDF vectors of the examples as postings in blocks of ``BLOCK`` examples.

    A term's postings in a block come with their largest weight, which bounds the
    share of that term in the cosine of any example of the block.
    """

    idf: dict[str, float]
    postings: dict[str, list[tuple[int, float, np.ndarray, np.ndarray]]]
    labels: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        raw = {t: (1.0 + math.log(n)) * self.idf[t] for t, n in counts.items() if t in self.idf}
        norm = math.sqrt(math.fsum(x * x for x in raw.values()))
        return {t: raw[t] / norm for t in sorted(raw)} if norm > 0 else {}

    def search(self, vector: dict[str, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine over 0, as (cosine, example), ties by example.

        Blocks come by falling bound; the rest is left once a bound is under the k-th
        cosine.  All cosines of a visited block are exact.
        """
        bound: dict[int, float] = {}
        held: dict[int, list] = {}
        for term, x in vector.items():
            for block, top, who, weights in self.postings.get(term, ()):
                bound[block] = bound.get(block, 0.0) + x * top
                held.setdefault(block, []).append((x, who, weights))
        best: list[tuple[float, int]] = []
        for block in sorted(bound, key=lambda b: (-bound[b], b)):
            if len(best) == k and bound[block] * (1 + 1e-9) < best[-1][0]:
                break
            scores = np.zeros(BLOCK)
            for x, who, weights in held[block]:
                scores[who] += x * weights
            found = np.flatnonzero(scores)
            mine = ((round(float(scores[i]), 9), int(i) + block * BLOCK) for i in found)
            best = sorted([*best, *(p for p in mine if p[1] != skip)], key=lambda p: (-p[0], p[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1, each neighbour weighing cosine to the fourth; absent neighbours vote the prior."""
        weights = [(s**4, self.labels[i]) for s, i in near]
        missing = NEIGHBOURS - len(near)
        floor = 0.05 * missing / NEIGHBOURS
        return (sum(w * y for w, y in weights) + floor * self.prior) / (sum(w for w, _ in weights) + floor) if near else self.prior

    def score(self, near: list[tuple[float, int]]) -> float:
        x = min(max(self.vote(near), 1e-6), 1 - 1e-6)
        z = self.slope * math.log(x / (1 - x)) + self.offset
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def chi_square(both: int, seen: int, toxic: int, total: int) -> float:
    """Of a stem in ``seen`` of ``total`` examples, ``both`` of them among the ``toxic`` ones."""
    spread = seen * (total - seen) * toxic * (total - toxic)
    return (both - seen * toxic / total) ** 2 * total**3 / spread if spread else 0.0


def choose(seen: dict[str, tuple[int, int]], toxic: int, total: int) -> dict[str, int]:
    """The terms of the index, with the number of examples that have them; ``seen``: (all, toxic ones) by stem."""
    return {t: m for t, (m, a) in sorted(seen.items()) if m >= RARE and chi_square(a, m, toxic, total) >= CHI_SQUARE}


def fit(examples: list[tuple[int, dict[str, int]]], prior: float) -> ToxicIndex:
    """Index (label, stem counts) examples; prior: share of label 1 among all labelled rows.

    Terms are the stems whose presence goes with the label (chi-square); counts of the stems that ``choose``
    would refuse may be left out.  The vote is calibrated by a logistic curve fitted to leave-one-out votes,
    classes weighed by the prior.
    """
    n, pos = len(examples), sum(y for y, _ in examples)
    seen, toxic = Counter(), Counter()
    for y, counts in examples:
        seen.update(counts.keys())
        if y:
            toxic.update(counts.keys())
    terms = choose({t: (m, toxic[t]) for t, m in seen.items()}, pos, n)
    index = ToxicIndex({t: math.log((n + 1) / (m + 1)) + 0.01 for t, m in terms.items()}, {}, np.array([y for y, _ in examples], np.int8), prior=prior)
    # like examples side by side, so that blocks have sharp bounds
    vectors = [index.vector(c) for _, c in examples]
    order = sorted(range(n), key=lambda i: (examples[i][0], max(vectors[i], key=lambda t: (vectors[i][t], t), default=""), i))
    vectors, index.labels = [vectors[i] for i in order], index.labels[order]
    lists: dict[str, dict[int, list]] = {}
    for i, vector in enumerate(vectors):
        for term, w in vector.items():
            lists.setdefault(term, {}).setdefault(i // BLOCK, []).append((i % BLOCK, w))
    for term, blocks in lists.items():
        index.postings[term] = [(b, max(w for _, w in rows), np.array([i for i, _ in rows]), np.array([w for _, w in rows])) for b, rows in sorted(blocks.items())]

    votes = np.array([index.vote(index.search(v, NEIGHBOURS, skip=i)) for i, v in enumerate(vectors)])
    y = index.labels.astype(float)
    weight = np.where(y == 1, prior / max(pos, 1), (1 - prior) / max(n - pos, 1)) * n
    x = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.log(x / (1 - x))
    theta = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-(theta[0] * x + theta[1])))
        design = np.stack([x, np.ones_like(x)])
        step = np.linalg.solve((design * (weight * p * (1 - p))) @ design.T + 1e-2 * np.eye(2), design @ (weight * (y - p)) - 1e-2 * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -1, 1)
    index.slope, index.offset = max(float(theta[0]), 1e-3), float(theta[1])
    return index


def read_examples(docs: DataFrame, labels: DataFrame, label: str, train, most: dict[int, int]) -> tuple[DataFrame, float]:
    """(id, y, text) of a bounded choice of labelled documents, cut, and the label's share.

    ``train``: a condition on doc_id.  Of each class the ``most[class]`` ids with the
    smallest hashes are read.  An id is one example: of several texts the least, labelled 1 if any
    row says so.  Null ids and labels teach nothing.  Ids may be of any type that both tables share.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y"))
    tally = {int(r.y): r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for y, limit in most.items()]
    chosen = cut(reduce(DataFrame.union, classes).select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y")))
    # the choice is bounded, so it is broadcast; an id that is there often is reduced before the exchange
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["id"]).groupBy("id", "y").agg(F.min(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text"))
    return cut(rows.repartition(EXAMPLE_TASKS, "id")), tally.get(1, 0) / max(1, sum(tally.values()))


def collect_features(examples: DataFrame, make, kinds: list) -> list[tuple[int, tuple]]:
    """[(label, features)] in the order of ids; ``make`` gives the ``kinds`` of Arrow arrays of a text, on the executors."""
    names = [f"f{i}" for i in range(len(kinds))]

    def run(batches):
        for batch in batches:
            made = [make(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=["id", "y", *names])

    schema = StructType([*examples.schema.fields[:2], *(StructField(n, from_arrow_type(k)) for n, k in zip(names, kinds))])
    return [(r.y, tuple(r[n] for n in names)) for r in sorted(in_batches(examples, run, schema).collect(), key=lambda r: r.id)]


def count_stems(examples: DataFrame) -> dict[str, tuple[int, int]]:
    """(examples, toxic examples) of every stem that ``RARE`` examples have; counted per batch before the exchange."""

    def run(batches):
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = stems(text).keys()
                seen.update(found)
                if y:
                    toxic.update(found)
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())], names=["stem", "seen", "toxic"])

    total, pos = examples.agg(F.count(F.lit(1)), F.sum("y")).first()
    counts = in_batches(examples, run, "stem string, seen long, toxic long").groupBy("stem").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    n, p, m, a = F.lit(float(total)), F.lit(float(pos or 0)), F.col("seen"), F.col("toxic")
    # as in chi_square, a little wider: the driver decides
    near = F.pow(a - m * p / n, 2) * F.pow(n, 3) >= F.lit(0.99 * CHI_SQUARE) * m * (n - m) * p * (n - p)
    return {r.stem: (r.seen, r.toxic) for r in counts.where((m >= RARE) & near).collect()}


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, toxic: int = TOXIC_EXAMPLES, clean: int = CLEAN_EXAMPLES) -> ToxicIndex:
    """The index of bounded labelled examples outside the held-out fold.

    Stems are counted and terms chosen over the executors; the driver gets the examples' vectors of chosen terms only.
    """
    examples, share = read_examples(docs, labels, "toxic", id_fold("doc_id", folds) != held_out, {1: toxic, 0: clean})
    total, pos = examples.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total:
        return ToxicIndex({}, {}, np.zeros(0, np.int8))
    terms = choose(count_stems(examples), pos, total)

    def make(text: str):
        counts = stems(text, terms)
        return list(counts), list(counts.values())

    found = collect_features(examples, make, [pa.list_(pa.string()), pa.list_(pa.int32())])
    return fit([(y, dict(zip(*f))) for y, f in found], min(max(share, 0.01), 0.99))


def score_toxicity(docs: DataFrame, index: ToxicIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, evidence: the nearest example's cosine and how many neighbours say 1.

    Every whole text is scored; null and empty texts, having no neighbours, get the calibrated prior.
    The index is bounded by its example counts and broadcast.  Repeated rows score alike; an empty table
    gives an empty result; ids may be null; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for batch in batches:
            near = [index.search(index.vector(stems(t or "", index.idf)), NEIGHBOURS) for t in (x.as_py() for x in batch.column(1))]
            score = [index.score(x) for x in near]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([x[0][0] if x else 0.0 for x in near], pa.float64()), pa.array([int(sum(index.labels[i] for _, i in x)) for x in near], pa.int32())],
                names=["id", "score", "predicted", "nearest", "toxic_neighbours"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows, run, f"id {kind}, score double, predicted int, nearest double, toxic_neighbours int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, index: ToxicIndex, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` less the rows that score ``threshold`` or more, in one pass and without moving a text.

    Rows are judged by their whole text alone: null and empty texts, having no neighbours, get the calibrated prior, repeated rows
    share one verdict, ids may be null or repeated.  All columns pass through; an empty table stays one.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(index), docs.columns

    def run(batches):
        index = shared.value
        for batch in batches:
            texts = batch.column(names.index(text_col))
            keep = [index.score(index.search(index.vector(stems(t.as_py() or "", index.idf)), NEIGHBOURS)) < threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(docs, run, docs.schema)
