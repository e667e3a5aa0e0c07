"""Statistics of row groups, gathered by the tasks that read them, and what they answer.

A row group is the rows of a block whose first byte is in a window of ``group_bytes``.  A task
reads whole groups, so that gathering needs no shuffle: it maps segments to one row per group
and column.  Tables of statistics are kept as Parquet beside the dump.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RefusedValue
from ..functions import values
from ..functions.columns import fast
from ..functions.pgtypes import Resolved
from ..sources.dumpmap import CopyBlock
from ..sources.rows import columns_of, row_bytes

#: Fixed limits: entries and bytes of a dictionary, bytes of a kept bound, groups of a block.
ENTRIES, ENTRY_BYTES, BOUND_BYTES, MOST_GROUPS, GROUP_BYTES, LEAST_ROWS = 64, 256, 256, 4096, 1 << 20, 1024
#: Bytes of the groups that a task gathers: each task writes a file for each column.
TASK_BYTES = 16 << 20

SCHEMA = (
    "block int, grp int, start long, end long, rows long, bytes long, name string, nulls long, low string, high string, low_exact boolean, high_exact boolean, "
    "order string, first string, last string, dictionary array<string>, beyond long, refused long, refusal string, value_bytes long, total decimal(38,0), total_scale int, dims_low int, dims_high int"
)


def group_size(block: CopyBlock, stated: int | None = None, median_row: float | None = None) -> int:
    """Bytes of a group: as stated, else 1 MiB, larger if a block would have over 4096 groups or groups under 1024 rows."""
    if stated:
        return stated
    size = max(GROUP_BYTES, math.ceil((block.data_end - block.data_start) / MOST_GROUPS))
    return max(size, math.ceil(LEAST_ROWS * median_row)) if median_row else size


def group_ranges(block: CopyBlock, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, block.data_end)) for a in range(block.data_start, block.data_end, size)]


def prefix(text: str) -> tuple[str, bool]:
    """A bound kept short: a prefix is not above the text."""
    raw = text.encode()
    return (text, True) if len(raw) <= BOUND_BYTES else (raw[:BOUND_BYTES].decode("utf-8", "ignore"), False)


def successor(text: str) -> tuple[str | None, bool]:
    """The prefix with its last character that can be raised raised: not under the text; None if there is none."""
    short, exact = prefix(text)
    if exact:
        return text, True
    for i in range(len(short) - 1, -1, -1):
        code = ord(short[i]) + 1
        if 0xD800 <= code <= 0xDFFF:
            code = 0xE000
        if code <= 0x10FFFF:
            return short[:i] + chr(code), False
    return None, False


def plain_stats(r: Resolved, column: pa.Array) -> dict | None:
    """The statistics by Arrow's kernels, if all values have the plain form of a type that Arrow orders as the database does."""
    kind = r.type.kind
    if kind not in ("int2", "int4", "int8", "oid", "float8", "decimal", "date", "timestamp", "text") or len(column) == column.null_count:
        return None
    typed = fast(r.type, column)
    if typed is None:
        return None
    distinct = pc.unique(column.drop_null())
    small = len(distinct) <= ENTRIES and (pc.max(pc.binary_length(distinct)).as_py() or 0) <= ENTRY_BYTES
    ordered = typed.cast(pa.binary()) if kind == "text" else typed
    edge = pc.min_max(ordered)
    low, high = (column[pc.index(ordered, edge[k]).as_py()].as_py() for k in ("min", "max"))
    present = column.drop_null()
    out = {"name": r.name, "nulls": column.null_count, "value_bytes": pc.sum(pc.binary_length(column)).as_py(), "dictionary": sorted(distinct.to_pylist()) if small else None, "beyond": 0, "refused": 0, "total": None, "total_scale": None, "order": "unsorted"}
    if kind in values.LIMITS or kind == "decimal":
        scale = r.type.args[1] if kind == "decimal" else 0
        total = pc.sum(typed.cast(pa.decimal128(38, scale))).as_py()
        out |= {"total": int(total.scaleb(scale, values.EXACT)), "total_scale": scale}
    out["low"], out["low_exact"] = prefix(low) if kind == "text" else (low, True)
    out["high"], out["high_exact"] = successor(high) if kind == "text" else (high, True)
    if out["high"] is None:
        out["low"] = None
    out |= {"first": prefix(present[0].as_py())[0], "last": prefix(present[-1].as_py())[0]}
    if not column.null_count:
        up, down = (len(ordered) < 2 or pc.all(test(ordered[:-1], ordered[1:])).as_py() for test in (pc.less_equal, pc.greater_equal))
        out["order"] = "constant" if up and down else "ascending" if up else "descending" if down else "unsorted"
    return out


def column_stats(r: Resolved, column: pa.Array) -> dict:
    """Statistics of one column of a group, from its field texts."""
    quick = plain_stats(r, column)
    if quick is not None:
        return quick
    items = column.to_pylist()
    present = [v for v in items if v is not None]
    counts = Counter(present)
    out = {"name": r.name, "nulls": len(items) - len(present), "value_bytes": sum(len(k.encode()) * n for k, n in counts.items())}
    small = len(counts) <= ENTRIES and all(len(v.encode()) <= ENTRY_BYTES for v in counts)
    out["dictionary"] = sorted(counts) if small else None
    keys, out["beyond"], out["refused"], total, scale = {}, 0, 0, 0, 0
    sums = r.type.kind in values.LIMITS or r.type.kind == "decimal"
    scale = r.type.args[1] if r.type.kind == "decimal" else 0
    shapes = []
    for v, n in counts.items():
        try:
            t = r.type
            if t.kind == "array":  # as many dimensions as the value has: that is what the census is about
                items = values.array_items(v, t.delimiter)
                t = replace(t, dims=values.dimensions(items))
                shapes += [t.dims] if items else []
            x = values.decode(t, v)
            keys[v] = values.order_key(t, v)
            if values.holds_beyond(x):
                out["beyond"] += n
            elif sums:
                total += int(x.scaleb(scale) if scale else x) * n
        except RefusedValue as e:
            out["refused"] += n
            out.setdefault("refusal", str(e)[:200])
    out |= {"total": total if sums and abs(total) < 10**38 else None, "total_scale": scale if sums else None}
    if r.type.kind == "array":
        out |= {"dims_low": min(shapes, default=None), "dims_high": max(shapes, default=None)}
    if keys and values.ordered(r.type):
        low, high = min(keys, key=keys.get), max(keys, key=keys.get)
        plain = r.type.kind in ("text", "varchar", "bpchar", "bytea")
        out["low"], out["low_exact"] = prefix(low) if plain else (low, True)
        out["high"], out["high_exact"] = successor(high) if plain else (high, True)
        if out["high"] is None or len(low) > 4 * BOUND_BYTES and not plain:
            out["low"] = out["high"] = None
        out |= {"first": prefix(present[0])[0], "last": prefix(present[-1])[0]}
        if len(keys) == len(counts) and not out["nulls"]:
            line = [keys[v] for v in present]
            up, down = all(a <= b for a, b in zip(line, line[1:])), all(a >= b for a, b in zip(line, line[1:]))
            out["order"] = "constant" if up and down else "ascending" if up else "descending" if down else "unsorted"
    out.setdefault("order", "unsorted")
    return out


def group_rows(source, item: tuple[CopyBlock, int, int, int], columns: dict[int, list[Resolved]]) -> list[dict]:
    """The statistics of one (block, group number, start, end), a row a column."""
    block, number, start, end = item
    wanted = columns[block.number]
    _, data = row_bytes(source, block, start, end)
    texts, rows = columns_of(data, block, [c.name for c in wanted])
    head = {"block": block.number, "grp": number, "start": start, "end": end, "rows": rows, "bytes": len(data)}
    empty = {"nulls": 0, "dims_low": None, "dims_high": None}
    return [head | empty | column_stats(c, texts[c.name]) for c in wanted] or [head | {"name": None, "nulls": 0}]


def gather(spark: SparkSession, source, work: list[tuple[CopyBlock, int, int, int]], columns: dict[int, list[Resolved]], tasks: int | None = None) -> DataFrame:
    """``SCHEMA`` rows for (block, group number, start, end) work items."""
    if not work:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast((source, work, columns))

    def run(batches):
        source, work, columns = shared.value
        kind = arrow_of()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = group_rows(source, work[i], columns)
                yield pa.RecordBatch.from_pylist([{n: f.get(n) for n in kind.names} for f in found], schema=kind)

    n = min(len(work), tasks or max(2 * spark.sparkContext.defaultParallelism, math.ceil(sum(end - start for _, _, start, end in work) / TASK_BYTES)))
    return spark.range(0, len(work), 1, n).mapInArrow(run, SCHEMA)


def arrow_of() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "decimal(38,0)": pa.decimal128(38, 0)}
    return pa.schema([(f.split(" ", 1)[0], kinds[f.split(" ", 1)[1]]) for f in SCHEMA.split(", ")])


def by_group(rows: list) -> dict[tuple[int, int], dict[str, dict]]:
    out: dict[tuple[int, int], dict[str, dict]] = {}
    for r in rows:
        out.setdefault((r["block"], r["grp"]), {})[r["name"]] = r.asDict() if hasattr(r, "asDict") else r
    return out


def block_order(r: Resolved, groups: list[dict]) -> str:
    """A block's order of a column, from that of its groups in turn."""
    if not groups or any(g["nulls"] or g["refused"] for g in groups):
        return "unsorted"
    kinds = {g["order"] for g in groups}
    for wanted, test in (("ascending", lambda a, b: a <= b), ("descending", lambda a, b: a >= b)):
        if kinds <= {wanted, "constant"}:
            ends = [values.order_key(r.type, g[k]) for g in groups for k in ("first", "last") if len((g[k] or "").encode()) < BOUND_BYTES]
            if len(ends) == 2 * len(groups) and all(test(a, b) for a, b in zip(ends, ends[1:])):
                return "constant" if ends[0] == ends[-1] else wanted
    return "unsorted"


def summary(found: DataFrame) -> DataFrame:
    """name, rows, nulls, value_bytes, beyond, refused and total of each column of a table of statistics."""
    return found.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("value_bytes").alias("value_bytes"), F.sum("beyond").alias("beyond"), F.sum("refused").alias("refused"),
        F.sum("total").alias("total"), F.max("total_scale").alias("total_scale"), F.bool_and(F.col("low_exact") & F.col("high_exact")).alias("exact"),
    )


def wrapped(total: int, bits: int = 64, signed: bool = True) -> int:
    """A sum as an integer of that width holds it."""
    total &= (1 << bits) - 1
    return total - (1 << bits) if signed and total >> (bits - 1) else total
