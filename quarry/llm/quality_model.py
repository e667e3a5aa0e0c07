"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, in_batches
from .toxicity import collect_features, read_examples

BUCKETS = 2048
RANK = 6
#: Labelled rows of each class that are read for training, at most.
EXAMPLES = 3000
EDGES = (0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
LENGTHS = (4, 5, 6, 7, 8, 9, 10, 12, 14)
STATS = (
    "symbol_words", "shout_words", "bar_words", "upper_share", "digit_share", "other_share", "repeat_next", "repeat_pairs",
    "top_word", "distinct_words", "duplicate_lines", "short_lines", "long_words", "sentence_marks", "blank_lines",
)
#: Features: hashed words, a step for each edge of each statistic, steps of the length, bias left apart.
SIZE = BUCKETS + len(STATS) * len(EDGES) + len(LENGTHS)
SYMBOLS = frozenset("#*$%&|<>")
TOKEN = re.compile(r"\w+|[^\w\s]+")


def statistics(text: str) -> list[float]:
    """Shares between 0 and 1, in the order of STATS, of a whole text."""
    words = text.split()
    n, lines = max(1, len(words)), text.split("\n")
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    filled = [x for x in lines if x.strip()]
    letters = sum(map(str.isalpha, text))
    size = max(1, len(text))
    return [
        sum(1 for w in words if not SYMBOLS.isdisjoint(w)) / n,
        sum(1 for w in words if w.endswith(("!!", "??"))) / n,
        counts.get("|", 0) / n,
        sum(map(str.isupper, text)) / max(1, letters),
        sum(map(str.isdigit, text)) / size,
        1 - (letters + sum(map(str.isspace, text))) / size,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
        sum(c - 1 for c in pairs.values()) / n,
        max(counts.values(), default=0) / n,
        len(counts) / n,
        (len(filled) - len(set(filled))) / max(1, len(filled)),
        sum(1 for x in filled if len(x) < 20) / max(1, len(filled)),
        sum(1 for w in words if len(w) > 25) / n,
        sum(text.count(c) for c in ".!?") / n,
        (len(lines) - len(filled)) / max(1, len(lines)),
    ]


def features(text: str) -> tuple[list[int], list[float]]:
    """Sparse features: words by damped and normalised counts, statistics and metadata as steps."""
    at: Counter = Counter()
    for word, n in Counter(TOKEN.findall(text.lower())).items():
        at[crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS] += n
    index = list(at)
    value = np.log1p(np.fromiter(at.values(), float, len(at)))
    value /= np.linalg.norm(value) or 1.0
    index, value = list(index), value.tolist()
    base = BUCKETS
    for x in statistics(text):
        index += [base + i for i, edge in enumerate(EDGES) if x > edge]
        base += len(EDGES)
    length = math.log(len(text) + 1)
    index += [base + i for i, edge in enumerate(LENGTHS) if length > edge]
    return index, value + [0.3] * (len(index) - len(value))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """w0 + sum w x + 1/2 (|sum v x|^2 - sum |v|^2 x^2), in time linear in the entries of each row."""
        rows = [r if r[0] else ([0], [0.0]) for r in rows]  # reduceat needs an entry in each row
        starts = np.cumsum([0, *(len(i) for i, _ in rows)])[:-1]
        index = np.fromiter((i for r, _ in rows for i in r), np.int64)
        value = np.fromiter((v for _, r in rows for v in r), np.float64)
        linear = np.add.reduceat(self.weight[index] * value, starts)
        part = self.factor[index] * value[:, None]
        total = np.add.reduceat(part, starts, axis=0)
        return self.bias + linear + 0.5 * (total**2 - np.add.reduceat(part**2, starts, axis=0)).sum(axis=1)

    def score(self, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40))) if rows else np.zeros(0)


def fit(examples: list[tuple[int, tuple[list[int], list[float]]]], share: float, rounds: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss; the classes are weighed to the share of 1 among all labelled rows."""
    random = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), random.normal(0, 0.02, (SIZE, RANK)))
    y = np.array([e[0] for e in examples], float)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    weight = np.sqrt(weight)  # between the population's shares and equal classes
    g_bias, g_weight, g_factor = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    for _ in range(rounds):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            dense = np.zeros((len(chosen), SIZE))
            for k, i in enumerate(chosen):
                dense[k, examples[i][1][0]] = examples[i][1][1]
            total = dense @ m.factor
            z = m.bias + dense @ m.weight + 0.5 * (total**2 - dense**2 @ m.factor**2).sum(axis=1)
            slope = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[chosen]) / len(chosen)
            d_bias, d_weight = slope.sum(), slope @ dense + decay * m.weight
            d_factor = dense.T @ (slope[:, None] * total) - (slope @ dense**2)[:, None] * m.factor + decay * m.factor
            g_bias += d_bias**2
            g_weight += d_weight**2
            g_factor += d_factor**2
            m.bias -= rate * d_bias / math.sqrt(g_bias)
            m.weight -= rate * d_weight / np.sqrt(g_weight)
            m.factor -= rate * d_factor / np.sqrt(g_factor)
    return m


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = EXAMPLES) -> Machine:
    """Fit on a bounded choice of labelled rows outside the held-out fold; features are made on the executors."""
    examples, share = read_examples(docs, labels, "quality", id_fold("doc_id", folds) != held_out, {1: most, 0: most})
    found = collect_features(examples, features, [pa.list_(pa.int32()), pa.list_(pa.float32())])
    return fit([(y, (list(f[0]), list(f[1]))) for y, f in found], min(max(share, 0.01), 0.99))


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every whole text.

    Null text counts as empty, and empty texts have features too (all of them at their lowest step).  The
    machine's size is fixed by BUCKETS and RANK.  Rows are independent: repeated rows score alike, empty
    tables give empty results; ids may be null; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(shared.value.score([features(t or "") for t in batch.slice(at, 256).column(1).to_pylist()]) for at in range(0, batch.num_rows, 256))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows, run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
