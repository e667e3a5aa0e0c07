"""SimHash near-duplicates: fingerprints, binary-trie self-join, linked components."""

from __future__ import annotations

from itertools import accumulate, combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SIGNATURE, cut, in_batches, keep_one, signature
from .components import components

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at a time, 64 bytes each.
CHUNK = 1 << 16


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text in UTF-8: A-Z lower-cased, ASCII white space apart."""
    words = raw.lower().split()  # on bytes: exactly A-Z and exactly the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, islice(ends, width - 1, None))), np.uint64, len(words) - width + 1)


def fingerprint(raw: bytes, width: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    hashes, votes = shingle_hashes(raw, width), np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, *more) -> DataFrame:
    """(id, fp long, more): the SimHash of each whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = pa.array([fingerprint(t.as_py() or b"", width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, *batch.columns[2:]], names=["id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    fields = rows.schema.fields
    return in_batches(rows, run, StructType([fields[0], StructField("fp", LongType()), *fields[2:]]))


class Forest:
    """Links among the sorted leaves of binary tries, as a forest of labels (least leaf of each part)."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the parts of a and b together and flatten."""
        label = self.label
        while a.size:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def same(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether all the leaves of two nodes are in one part already."""
        changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return (changes[lo] == changes[hi - 1]) & (changes[lo2] == changes[hi2 - 1]) & (self.label[lo] == self.label[lo2])


def trie_self_join(code: np.ndarray, bucket: np.ndarray, budget: int, depth: int = BITS, step: int = 1 << 18) -> np.ndarray:
    """Label each of the distinct codes, sorted within sorted buckets, by the least index it is linked to.

    The codes of a bucket are the leaves of a binary trie whose nodes are index ranges.
    Pairs of nodes go down together, bit by bit from ``depth``; each pair carries the
    number of bits in which its two paths differ and goes no further once that is over
    the budget, nor once both nodes hold leaves of one linked part only.  At most a few times
    ``step`` pairs are in memory: the rest wait on a stack, deepest first.
    """
    size = len(code)
    forest = Forest(size)
    if size < 2:
        return forest.label
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([cuts[1:], [size]])
    many = ends - cuts > 1
    roots, tops = cuts[many], ends[many]
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((code >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return ones[bit]

    stack = [(depth - 1, roots, tops, roots, tops, np.zeros(len(roots), np.int8))]
    while stack:
        bit, a, az, b, bz, err = stack.pop()
        while a.size:
            if a.size > step:
                half = a.size // 2
                stack.append((bit, a[:half], az[:half], b[:half], bz[:half], err[:half]))
                a, az, b, bz, err = a[half:], az[half:], b[half:], bz[half:], err[half:]
                continue
            own = a == b
            leaf = np.where(own, az - a == 2, (az - a == 1) & (bz - b == 1))
            if leaf.any():  # two leaves are left: all their bits at once
                x, y = a[leaf], np.where(own, a + 1, b)[leaf]
                near = np.bitwise_count(code[x] ^ code[y]) <= budget
                forest.link(x[near], y[near])
            go = ~leaf
            if go.sum() > 4096:
                go &= ~forest.same(a, az, b, bz)
            a, az, b, bz, err, own = a[go], az[go], b[go], bz[go], err[go], own[go]
            if not a.size or bit < 0:
                break
            before = ones_before(bit)
            am, bm = az - (before[az] - before[a]), bz - (before[bz] - before[b])
            over = ~own
            parts = [(a, am, b, bm, err), (am, az, bm, bz, err), (a, am, bm, bz, err + 1), (am[over], az[over], b[over], bm[over], err[over] + 1)]
            a, az, b, bz, err = (np.concatenate([p[i] for p in parts]) for i in range(5))
            live = (a < az) & (b < bz) & (err <= budget) & ~((a == b) & (az - a < 2))
            a, az, b, bz, err = a[live], az[live], b[live], bz[live], err[live]
            bit -= 1
    return forest.label


#: Fingerprints of even spread that a bucket holds on average, at most.
FILL = 32
#: Distinct fingerprints of a bucket that one task joins with each other at most.
HOT = 1 << 15
#: Rows (a key and a fingerprint, 24 bytes) that one task sorts at most, on average.
TASK_ROWS = 1 << 19


def block_keys(rows: int, budget: int) -> list[int]:
    """The bucket keys, as bit masks.

    Of budget + r blocks at least r agree in a linked pair, so that all sets of r blocks find
    all links, whatever r.  r is the least from 2 with which a bucket holds ``FILL`` of so many
    rows: for a budget of 4, 15 keys of 21 bits up to 2^26 rows, then 35 of 27 bits.
    """
    agree = next(r for r in range(2, BITS - budget) if rows <= FILL << (BITS * r // (budget + r)) or r == 4)
    blocks = budget + agree
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, agree)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(codes: DataFrame, budget: int = 4) -> DataFrame:
    """(u, v) edges among the distinct 64-bit ``fp`` values that connect what differs in ``budget`` bits or fewer.

    The edges are spanning stars of each task's linked parts, not all pairs: a group of
    near copies of any size gives at most one edge per key, fingerprint and cell.

    Every fingerprint goes to the bucket of each key mask (pigeonhole: a linked pair agrees on
    at least one).  Buckets of over ``HOT`` fingerprints are dealt to a triangle of
    cells, each holding two of the bucket's slices, so that every pair meets in one cell
    and no task gets a hot bucket whole.
    """
    total = codes.count()
    masks = block_keys(total, budget)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)])
    dealt = codes.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = dealt.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = cut(sizes)
    slices = F.ceil(F.col("n") / F.lit(HOT)).cast("int") + F.when(F.col("n") > HOT, 1).otherwise(0)
    dealt = dealt.join(sizes, ["k", "v"]).withColumn("g", slices)
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda s: s != own)
    cells = F.when(F.col("g") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    cells = cells.otherwise(F.transform(others, lambda s: F.struct(F.least(s, own).alias("x"), F.greatest(s, own).alias("y"))))
    dealt = dealt.select("fp", "k", "v", F.explode(cells).alias("cell"))
    dealt = dealt.select("fp", F.xxhash64("k", "v", "cell.x", "cell.y").alias("bucket"))
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * len(masks) // TASK_ROWS)

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        data = pa.Table.from_batches(rows)
        fp = data.column("fp").to_numpy().view(np.uint64)
        bucket = data.column("bucket").to_numpy()
        order = np.lexsort((fp, bucket))
        fp, bucket = fp[order], bucket[order]
        label = trie_self_join(fp, bucket, budget)
        moved = label != np.arange(len(label))
        u, v = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], names=["u", "v"])

    return in_batches(dealt.select("fp", "bucket").repartition(parts, "bucket"), run, "u long, v long")


def linked(codes: DataFrame, budget: int) -> DataFrame:
    """(fp, part): the least linked fingerprint of each of the distinct ``codes``."""
    parts = components(links(codes.select("fp"), budget))
    return codes.join(parts, F.col("fp") == F.col("node"), "left").select(*codes.columns, F.coalesce("component", "fp").alias("part"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id, the least id reachable over links of ``budget`` bits.

    Copies share a fingerprint and are joined as one, whatever their number; texts
    without words have fingerprint 0 and are linked like others.  Null text counts as empty;
    a null id is no candidate for the least id unless all ids of a component are null.
    Repeated rows share their component.  Extra columns are ignored; empty tables give empty results.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    codes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    joined = linked(codes, budget)
    # cut, so that the join has an exchange of its own on either side and can split a hot component
    least = cut(joined.groupBy("part").agg(F.min("least").alias("component_id")))
    by_code = joined.join(least, "part").select("fp", "component_id")
    return marked.join(by_code, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one document, the one with the least id, of each linked component (see ``near_groups``).

    Rows are judged one by one, not by id: null ids come last, then the hash of the text decides; of rows that
    repeat both id and text any one stays.  Rows that are linked to nothing stay though
    they share an id with one that goes, or have none.  Null text counts as empty.  All
    columns pass through; an empty table stays one.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width, *signature(id_col, text_col)[1:]).withColumnRenamed("id", "__i"))
    codes = cut(marked.select("fp").distinct())
    grouped = cut(linked(codes, budget))
    return keep_one(docs, marked.join(grouped, "fp").select("part", *SIGNATURE), "part", [], id_col, text_col)
