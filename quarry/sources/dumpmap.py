"""The map of a dump: a tiling of its bytes into spans, with every COPY block and declaration.

The structure has to be read in order, because a COPY line within a quoted function body is no block.
Bodies of blocks are not structure, though: executors first look, in byte ranges, for the
lines that can end a block, and the driver then reads the text between blocks only.  Small
sources are read on the driver throughout.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import AmbiguousTable, DumpError
from . import ddl
from .copytext import IDENTIFIER, MAX_LINE, CopyHeader, parse_header, unquote
from .lexer import Lexer

#: Bytes that a task searches, and up to which the driver searches alone.
RANGE = 64 << 20
CHUNK = 4 << 20
TOC = re.compile(r"^-- (?:Data for )?Name: (?P<name>.*?); Type: (?P<type>.*?); Schema: (?P<schema>.*?); Owner: (?P<owner>.*?)(?:; Tablespace: (?P<tablespace>.*?))?\s*$")
ROOT_MARK = re.compile(r"^-- load via partition root (.*?)\s*$")


@dataclass
class Span:
    start: int
    end: int
    kind: str
    database: str | None = None
    name: str | None = None
    text: str | None = None


@dataclass
class CopyBlock:
    number: int
    database: str | None
    header: CopyHeader
    start: int  # of the header line
    data_start: int
    data_end: int  # offset of the terminator line
    end: int
    crlf: bool = False
    partition_root: str | None = None

    @property
    def key(self) -> tuple[str | None, str]:
        return self.header.schema, self.header.table


@dataclass
class DumpMap:
    location: str
    source: object
    identity: dict
    spans: list[Span] = field(default_factory=list)
    blocks: list[CopyBlock] = field(default_factory=list)
    databases: dict[str | None, ddl.Database] = field(default_factory=dict)
    toc: list[dict] = field(default_factory=list)
    complete: bool = True

    def blocks_of(self, database: str | None, key: tuple[str | None, str]) -> list[CopyBlock]:
        return [b for b in self.blocks if b.database == database and b.key == key]

    def find(self, table: str, schema: str | None = None, database: str | None = None) -> tuple[str | None, tuple[str | None, str]]:
        """(database, (schema, table)) of the one table of that name; refuses to guess among several."""
        found = []
        for name, db in self.databases.items():
            keys = dict.fromkeys([*db.tables, *(b.key for b in self.blocks if b.database == name)])
            found += [(name, k) for k in keys if k[1] == table and schema in (None, k[0]) and (database is None or database == name)]
        if not found:
            raise DumpError(f"the dump has no table {table}")
        if len(found) > 1:
            raise AmbiguousTable(f"{table} may be " + ", ".join(".".join(str(p) for p in (d, *k) if p) for d, k in found))
        return found[0]


def lines(source, start: int, end: int):
    """(offset, line with its end) from ``start`` to ``end``; a read of at most ``CHUNK`` bytes at a time."""
    rest, at = b"", start
    while at < end or rest:
        data = source.read(at, min(at + CHUNK, end)) if at < end else b""
        at += len(data)
        parts = (rest + data).split(b"\n")
        first = at - len(rest) - len(data)
        rest = parts.pop()
        for p in parts:
            yield first, p + b"\n"
            first += len(p) + 1
        if not data:
            if rest:
                yield first, rest
            return
        if len(rest) > MAX_LINE:
            raise DumpError(f"a line of over {MAX_LINE} bytes")


def terminators(source, start: int, end: int) -> list[int]:
    """Offsets of the lines in [start, end) that are a backslash and a full stop."""
    found, at = [], start
    while at < end:
        stop = min(at + CHUNK, end)
        # with the byte before, or a line feed before the first one, so that each line follows one
        data = source.read(at - 1, stop + 3) if at else b"\n" + source.read(0, stop + 3)
        m = data.find(b"\n\\.")
        while m >= 0:
            if at + m < stop and (data[m + 3 : m + 4] in (b"\n", b"") or data[m + 3 : m + 5] == b"\r\n"):
                found.append(at + m)
            m = data.find(b"\n\\.", m + 1)
        at = stop
    return found


def all_terminators(spark: SparkSession | None, source, size: int) -> list[int]:
    if spark is None or size <= RANGE:
        return terminators(source, 0, size)
    ranges = [(a, min(a + RANGE, size)) for a in range(0, size, RANGE)]
    rows = spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges), "a")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(terminators(source, a, b), pa.int64())], names=["offset"])

    # as many rows as the dump has blocks, which the map lists anyway
    return sorted(r.offset for r in rows.mapInArrow(run, "offset long").collect())


def scan_structure(location: str, source, spark: SparkSession | None = None, preamble_only: bool = False) -> DumpMap:
    """Map a source; ``preamble_only`` stops at the first block, at a cost that does not depend on the size."""
    size = source.size()
    out = DumpMap(location, source, source.identity(), databases={None: ddl.Database()})
    ends = [] if preamble_only else all_terminators(spark, source, size)
    lexer, db, at = Lexer(), out.databases[None], 0
    begun, root, objects = 0, None, False
    while at < size:
        for offset, raw in lines(source, at, size):
            at = offset + len(raw)
            line = raw.decode("utf-8", "surrogateescape")
            header = parse_header(line) if lexer.idle else None
            if header:
                if preamble_only:
                    out.complete = False
                    return out
                if begun < offset:
                    out.spans.append(Span(begun, offset, "framing", db.name))
                k = bisect_left(ends, at)
                if k == len(ends):
                    raise DumpError(f"the block of {header.table} at {offset} has no end")
                last = source.read(ends[k], min(size, ends[k] + 4))
                end = ends[k] + (last.index(b"\n") + 1 if b"\n" in last else len(last))
                block = CopyBlock(len(out.blocks), db.name, header, offset, at, ends[k], end, raw.endswith(b"\r\n"), root)
                out.blocks.append(block)
                out.spans.append(Span(offset, end, "copy", db.name, header.table))
                begun = at = end
                root = None
                break  # go on after the block
            if lexer.in_code:
                if toc := TOC.match(line):
                    out.toc.append(toc.groupdict() | {"offset": offset, "database": db.name})
                if mark := ROOT_MARK.match(line):
                    root = mark[1]
                if lexer.idle and line.strip() in ("BEGIN;", "COMMIT;"):
                    objects = line.startswith("BEGIN")
                if version := re.match(r"-- Dumped from database version (\S+)", line):
                    db.version = version[1]
            for statement in lexer.feed(line):
                kind = "large_objects" if objects and statement.startswith("SELECT pg_catalog.lo") else ""
                if connect := re.match(rf"\\connect (?:-reuse-previous=on )?(?:\"dbname='(.*?)'\"|({IDENTIFIER}))", statement):
                    name = connect[1] or unquote(connect[2])
                    db, kind = out.databases.setdefault(name, ddl.Database(name)), "connect"
                elif statement.startswith("INSERT INTO "):
                    kind = "insert_run"
                elif set_ := re.match(r"SET standard_conforming_strings = (\w+)", statement):
                    lexer.escapes = set_[1] == "off"
                kind = kind or ddl.apply(db, statement)
                before = out.spans[-1] if out.spans else None
                if kind in ("insert_run", "large_objects", "framing") and before and before.kind == kind and before.end == begun:
                    before.end = at
                else:
                    out.spans.append(Span(begun, at, kind, db.name, text=statement if kind not in ("insert_run", "large_objects") else None))
                begun = at
    if begun < size:
        out.spans.append(Span(begun, size, "framing" if lexer.idle else "unparsed", db.name))
    # the database without a name goes if all is under \connect
    if len(out.databases) > 1 and not out.databases[None].tables and not any(b.database is None for b in out.blocks):
        del out.databases[None]
    return out


def check_tiling(found: DumpMap, size: int) -> None:
    """Every byte is in one span."""
    at = 0
    for s in found.spans:
        if s.start != at or s.end < s.start:
            raise AssertionError(f"the span at {s.start} does not follow {at}")
        at = s.end
    if at != size:
        raise AssertionError(f"the spans end at {at} of {size}")
