"""Typed scans: byte ranges of COPY blocks, filtered and decoded by the tasks that read them."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SourceChanged
from ..functions.columns import Modes, decode_column, holds_limits
from ..functions.pgtypes import Resolved, arrow_type
from ..plans.dialect import MARKED as MARK
from ..plans.predicate import COMPARE, Bound, columns_of
from ..sources.copytext import MAX_LINE
from ..sources.dumpmap import CopyBlock
from ..sources.rows import Segment, columns_of as read_columns, row_bytes, row_offsets

#: Bytes of a task's segment, and rows of a batch.
SEGMENT, BATCH_ROWS = 32 << 20, 16_384
OFFSET = "_offset"


@dataclass
class ScanSpec:
    """All that a task needs; small, but for the list of segments."""

    source: object
    identity: dict
    blocks: dict[int, CopyBlock]
    segments: list[Segment]
    columns: list[Resolved]
    modes: Modes = field(default_factory=Modes)
    filter: Bound | None = None
    offsets: bool = False
    watch: bool = True
    sortedness: dict[int, dict[str, str]] = field(default_factory=dict)
    #: Rows that are asked of the whole scan: no segment gives more.
    limit: int | None = None
    #: Columns with a mark.
    marks: list[str] = field(default_factory=list)
    #: Bytes of the longest row that is read.
    longest: int = MAX_LINE

    def schema(self) -> T.StructType:
        out = T.StructType([column_field(c, self.modes) for c in self.columns])
        for n in self.marks:
            out.add(MARK + n, T.BooleanType())
        return out.add(OFFSET, T.LongType()) if self.offsets else out

    def check(self) -> None:
        now = self.source.identity() if self.watch else self.identity
        if any(now[k] != self.identity[k] for k in ("size", "modified")):
            raise SourceChanged("the source has changed since it was mapped")

    def read(self, segment: Segment):
        """Batches of a segment's kept rows."""
        block = self.blocks[segment.block]
        filter_columns = columns_of(self.filter.tree) if self.filter else []
        asked = list(dict.fromkeys([*filter_columns, *self.marks, *(c.name for c in self.columns)]))
        wanted = [n for n in asked if n in (block.header.columns or ())]
        base, data = row_bytes(self.source, block, segment.start, segment.end, self.longest)
        texts, rows = read_columns(data, block, wanted)
        for n in set(asked) - set(wanted):
            texts[n] = pa.nulls(rows, pa.string())
        where = pa.array(row_offsets(data, base)) if self.offsets else None
        if self.filter and rows:
            stop = self.filter.stop_rule(self.sortedness.get(block.number, {}))
            if stop:
                rows = self.early_stop(texts, rows, *stop)
                texts = {n: a.slice(0, rows) for n, a in texts.items()}
                where = where.slice(0, rows) if where is not None else None
            keep = pc.fill_null(self.filter.matches(texts, rows), False)
            texts = {n: texts[n].filter(keep) for n in dict.fromkeys([*(c.name for c in self.columns), *self.marks])}
            where = where.filter(keep) if where is not None else None
            rows = pc.sum(keep).as_py() or 0
        rows = rows if self.limit is None else min(rows, self.limit)
        for at in range(0, rows, BATCH_ROWS):
            size = min(BATCH_ROWS, rows - at)
            out = [decode_column(texts[c.name].slice(at, size), c, self.modes) for c in self.columns]
            out += [self.filter.beyond(self.filter.columns[n], texts[n].slice(at, size)) for n in self.marks]
            out += [where.slice(at, size)] if where is not None else []
            yield size, out

    def early_stop(self, texts: dict, rows: int, name: str, op: str, key) -> int:
        """Rows of a sorted column before the first that fails its bound, by bisection; NULLs don't bisect."""
        column, r = texts[name], self.filter.columns[name]
        if column.null_count:
            return rows
        low, high = 0, rows
        while low < high:
            middle = (low + high) // 2
            if COMPARE[op](self.filter.key(r.type, column[middle].as_py()), key):
                low = middle + 1
            else:
                high = middle
        return low


def column_field(r: Resolved, modes: Modes) -> T.StructField:
    if modes.unrepresentable == "text" and holds_limits(r.type):
        return T.StructField(r.name, T.StringType(), True, r.field().metadata)
    return r.field()


def scan(spark: SparkSession, spec: ScanSpec, tasks: int | None = None) -> DataFrame:
    """A DataFrame over the segments, one or a few a task, without a shuffle."""
    spec.check()
    schema, segments = spec.schema(), spec.segments
    if not segments:
        return spark.createDataFrame([], schema)
    n = min(len(segments), tasks or 20_000)
    shared = spark.sparkContext.broadcast(spec)
    counting = not schema.fields

    def run(batches):
        spec = shared.value
        spec.check()
        names = [f.name for f in schema.fields]
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if counting:
                    rows = sum(size for size, _ in spec.read(spec.segments[i]))
                    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])
                    continue
                for _, out in spec.read(spec.segments[i]):
                    yield pa.RecordBatch.from_arrays(out, names=names)
        spec.check()

    ids = spark.range(0, len(segments), 1, n)
    if counting:  # no column: as many empty rows
        counts = ids.mapInArrow(run, "rows long")
        return counts.selectExpr("explode(array_repeat(true, cast(rows AS int))) AS one").select()
    return ids.mapInArrow(run, schema)


def arrow_schema(columns: list[Resolved]) -> pa.Schema:
    return pa.schema([(c.name, arrow_type(c.type)) for c in columns])
