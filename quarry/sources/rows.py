"""Rows of a COPY block's byte range, as columns of field text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv

from ..errors import DumpError
from ..functions.columns import unescaped
from .copytext import MAX_LINE
from .dumpmap import CopyBlock

STEP = 1 << 20


@dataclass(frozen=True)
class Segment:
    """Rows of a block whose first byte is in [start, end)."""

    block: int
    start: int
    end: int


def row_bytes(source, block: CopyBlock, start: int, end: int, longest: int = MAX_LINE) -> tuple[int, bytes]:
    """(offset of the first row, bytes of all whole rows) that begin in [start, end); a row over ``longest`` bytes is refused."""
    start, end = max(start, block.data_start), min(end, block.data_end)
    if start >= end:
        return start, b""
    inner = start > block.data_start
    base = start - 1 if inner else start
    data = source.read(base, end)
    if inner:  # the row that begins before is another range's
        cut = data.find(b"\n") + 1
        while not cut:
            if base + len(data) >= end:
                return end, b""
            data += source.read(base + len(data), end)
            cut = data.find(b"\n") + 1
        base, data = base + cut, data[cut:]
    at = end
    parts = [data]
    if data and not data.endswith(b"\n"):
        last = end - len(data) + data.rfind(b"\n") + 1
        while at < block.data_end:
            if at - last > longest:
                raise too_long(block, last, longest)
            more = source.read(at, min(at + STEP, block.data_end))
            stop = more.find(b"\n") + 1
            parts.append(more[:stop] if stop else more)
            at += len(more)
            if stop:
                break
    data = b"".join(parts)
    if len(data) > longest:
        starts = row_offsets(data, base)
        lengths = np.diff(np.append(starts, base + len(data)))
        if lengths.max() > longest:
            raise too_long(block, int(starts[lengths.argmax()]), longest)
    return base, data


def too_long(block: CopyBlock, at: int, longest: int) -> DumpError:
    return DumpError(f"{block.header.table}: the row at byte {at} has over {longest} bytes")


def columns_of(data: bytes, block: CopyBlock, wanted: list[str]) -> tuple[dict[str, pa.Array], int]:
    """Unescaped text of the wanted columns, and the number of rows; other columns are split but not made."""
    names = list(block.header.columns or ())
    rows = data.count(b"\n") + (bool(data) and not data.endswith(b"\n"))
    if b"\r" in data:
        if data.count(b"\r") != data.count(b"\r\n") or data.count(b"\r\n") != data.count(b"\n") or not block.crlf:
            raise DumpError(f"{block.header.table}: carriage returns that end no line, or line ends of two kinds")
    if not names:
        if data.replace(b"\r", b"").strip(b"\n"):
            raise DumpError(f"{block.header.table}: a row has fields, but the header names no column")
        return {}, rows
    if not wanted or not rows:
        return {n: pa.array([], pa.string()) if not rows else None for n in wanted}, rows
    try:
        table = csv.read_csv(
            pa.BufferReader(data), csv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
            csv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False),
            csv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=["\\N"], strings_can_be_null=True, include_columns=wanted),
        )
    except pa.ArrowInvalid as e:
        raise DumpError(f"{block.header.table}: {e}") from None
    return {n: unescaped(table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0)) for n in wanted}, table.num_rows


def row_offsets(data: bytes, base: int) -> np.ndarray:
    """Offsets of the rows' first bytes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    starts = np.concatenate([[0], ends])
    return base + (starts[:-1] if len(data) and data.endswith(b"\n") else starts if len(data) else starts[:0])


def cut_block(block: CopyBlock, target: int, cuts: list[int] | None = None) -> list[Segment]:
    """Segments of about ``target`` bytes; at the source's own cuts where it can't be entered elsewhere."""
    if block.data_start >= block.data_end:
        return []
    if cuts is None:
        edges = list(range(block.data_start, block.data_end, max(1, target)))
    else:
        edges, last = [block.data_start], block.data_start
        for c in cuts:
            if block.data_start < c < block.data_end and c - last >= target:
                edges.append(c)
                last = c
    return [Segment(block.number, a, b) for a, b in zip(edges, [*edges[1:], block.data_end])]
