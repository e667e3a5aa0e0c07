"""Results back as the database's own text, and other prints."""

from __future__ import annotations

from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import values
from ..functions.columns import stored
from ..functions.pgtypes import PgType
from ..sources.copytext import escape
from .dump import DumpTable


def whole(array: pa.Array) -> list:
    """Values as ``render`` takes them: days and microseconds as integers, at any depth."""
    def plain(a: pa.Array) -> pa.Array:
        kind = stored(a.type)
        if kind == a.type:
            return a
        if pa.types.is_list(a.type):
            return pa.ListArray.from_arrays(a.offsets, plain(a.values), mask=pc.is_null(a) if a.null_count else None)
        if pa.types.is_struct(a.type):
            fields = [kind.field(i) for i in range(kind.num_fields)]
            return pa.StructArray.from_arrays([plain(a.field(i)) for i in range(kind.num_fields)], fields=fields, mask=pc.is_null(a) if a.null_count else None)
        return a.cast(kind)

    return plain(array).to_pylist()


def rendered(table: DumpTable, columns: list[str] | None = None, **options) -> DataFrame:
    """One column ``line``: tab-separated field texts, NULL as backslash N; rendered where the rows are."""
    names = table.names if columns is None else columns
    kinds: list[PgType] = [table._resolved(n).type for n in names]
    found = table.scan(names, **options)

    def run(batches):
        for batch in batches:
            texts = [[escape(None if v is None else v if isinstance(v, str) else values.render(t, v)) for v in whole(c)] for t, c in zip(kinds, batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map("\t".join, zip(*texts))), pa.string())], names=["line"])

    if not names:  # empty lines, as many as rows
        return found.selectExpr("'' AS line")
    return found.mapInArrow(run, "line string")


def chunk_text(rows, form: str) -> str:
    if form in ("csv", "tsv"):
        return rows.to_csv(index=False, sep="," if form == "csv" else "\t")
    if form in ("json", "ndjson"):
        return rows.to_json(orient="records", lines=form == "ndjson", date_format="iso")
    return rows.to_string(index=False)


def show(df: DataFrame, form: str = "table", limit: int = 1000) -> str:
    """The first ``limit`` rows of a result as table, csv, tsv, json or ndjson."""
    return chunk_text(df.limit(limit).toPandas(), form)


def shown(df: DataFrame, form: str = "table", chunk: int = 1000):
    """All rows of a result as lines of text, a chunk of rows on the driver at a time; tables are aligned by chunk."""
    rows, first = iter(df.toLocalIterator(prefetchPartitions=True)), True
    while True:
        part = list(islice(rows, chunk))
        if not part and not first:
            break
        text = chunk_text(pd.DataFrame([tuple(r) for r in part], columns=df.columns) if part or form != "table" else pd.DataFrame(columns=df.columns), form).rstrip("\n")
        if form in ("csv", "tsv") and not first:
            text = text.partition("\n")[2]
        elif form == "table" and not first:
            text = text.partition("\n")[2]
        elif form == "json":  # one array over all chunks
            text = ("[" if first else ",") + text[1:-1]
        if text or form != "ndjson":
            yield text
        first = False
        if not part:
            break
    if form == "json":
        yield "]"
