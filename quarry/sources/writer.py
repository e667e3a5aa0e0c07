"""Writing dumps of DataFrames, for tests and checks: the reading side's counterpart."""

from __future__ import annotations

import datetime as dt
import gzip
import os
import re
import shutil
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .copytext import escape, quote

PG = {T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.StringType: "text", T.DateType: "date", T.TimestampNTZType: "timestamp without time zone", T.TimestampType: "timestamp with time zone", T.BinaryType: "bytea"}


def pg_type(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"numeric({t.precision},{t.scale})"
    return pg_type(t.elementType) + "[]" if isinstance(t, T.ArrayType) else PG[type(t)]


def field(value) -> str:
    if value is None:
        return "\\N"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, float):
        return "NaN" if value != value else repr(value) if abs(value) != float("inf") else ("Infinity" if value > 0 else "-Infinity")
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
        return text + ("+00" if value.tzinfo else "")
    if isinstance(value, (bytes, bytearray)):
        return "\\\\x" + bytes(value).hex()
    if isinstance(value, list):
        return escape("{" + ",".join("NULL" if v is None else repr(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"' for v in value) + "}")
    return escape(f"{value:f}" if isinstance(value, Decimal) else str(value))


HEAD = "--\n-- PostgreSQL database dump\n--\n\n-- Dumped from database version 17.2\n-- Dumped by pg_dump version 17.2\n\nSET standard_conforming_strings = on;\n\n"


def create_table(schema: str, name: str, columns: list[tuple[str, str]], tail: str = "") -> str:
    body = ",\n".join(f"    {quote(n)} {t}" for n, t in columns)
    return f"--\n-- Name: {name}; Type: TABLE; Schema: {schema}; Owner: postgres\n--\n\nCREATE TABLE {quote(schema)}.{quote(name)} (\n{body}\n){tail};\n\n"


def copy_block(schema: str, name: str, columns: list[str], rows) -> str:
    lines = "".join("\t".join(map(field, row)) + "\n" for row in rows)
    head = f"--\n-- Data for Name: {name}; Type: TABLE DATA; Schema: {schema}; Owner: postgres\n--\n\n"
    return f"{head}COPY {quote(schema)}.{quote(name)} ({', '.join(map(quote, columns))}) FROM stdin;\n{lines}\\.\n\n\n"


def field_text(c: T.StructField) -> Column:
    """A column's field text, by Spark."""
    x = F.col(f"`{c.name}`")
    if isinstance(c.dataType, T.BooleanType):
        x = F.when(x, "t").when(~x, "f")
    elif isinstance(c.dataType, T.TimestampType):
        x = F.concat(x.cast("timestamp_ntz").cast("string"), F.lit("+00"))
    elif isinstance(c.dataType, T.BinaryType):
        x = F.concat(F.lit("\\\\x"), F.lower(F.hex(x)))
    elif isinstance(c.dataType, T.ArrayType):
        x = F.concat(F.lit("{"), F.array_join(x.cast("array<string>"), ",", "NULL"), F.lit("}"))
    elif isinstance(c.dataType, T.StringType):
        for plain, mark in (("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v")):
            x = F.replace(x, F.lit(plain), F.lit(mark))
    return F.coalesce(x.cast("string"), F.lit("\\N"))


#: Bytes that are packed on their own, and read at a time.
CHUNK = 4 << 20
#: Bytes of a table's rows that are on disk twice at most, or the SHARE-th part of them if that is more.
TWICE, SHARE = 256 << 20, 16


def by_tasks(spark: SparkSession, items: list, work: Callable[..., int]) -> list[int]:
    """The number that ``work`` gives for each item, a task each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([work(*items[i])], pa.int64())], names=["i", "n"])

    rows = spark.range(0, len(items), 1, len(items)).mapInArrow(run, "i long, n long").collect() if items else []
    return [r.n for r in sorted(rows)]


def placed(spark: SparkSession, path: str, files: list[tuple[str, int]], at: int) -> int:
    """Files, with their sizes, copied by tasks into ``path`` one after the other from ``at`` on, and removed; the end of the last one."""

    def copy(source: str, start: int, size: int) -> int:
        with open(source, "rb") as f, open(path, "r+b") as out:
            out.seek(start)
            done = 0
            while data := f.read(CHUNK):
                done += out.write(data)
        if done != size:
            raise OSError(f"{source} has {done} bytes, not {size}")
        return done

    step, most = [], max(TWICE, sum(size for _, size in files) // SHARE)
    for k, (source, size) in enumerate(files, 1):
        step.append((source, at, size))
        at += size
        if at - step[0][1] >= most or k == len(files):
            # a repeated task writes the same bytes to the same place; sources go when all tasks are done
            by_tasks(spark, step, copy)
            for f, _, _ in step:
                os.unlink(f)
            step = []
    return at


def packed(spark: SparkSession, files: list[str], pack: Callable[[bytes], bytes]) -> list[tuple[str, int]]:
    """Gzip files packed otherwise by tasks, CHUNK bytes of text at a time, with their sizes."""

    def run(source: str) -> int:
        part = f"{source}.{uuid.uuid4().hex}"
        with gzip.open(source) as f, open(part, "wb") as out:
            while data := f.read(CHUNK):
                out.write(pack(data))
        os.replace(part, f"{source}.packed")
        return os.path.getsize(f"{source}.packed")

    sizes = by_tasks(spark, [(f,) for f in files], run)
    for f in files:
        os.unlink(f)
    return [(f"{f}.packed", n) for f, n in zip(files, sizes)]


def write_rows(path: str, df: DataFrame, at: int, pack: Callable[[bytes], bytes] | None = None) -> int:
    """The rows of a COPY block from ``at`` on in ``path``, in the order of the partitions; their end.

    Tasks write files beside ``path``, whose folder the driver and the executors share: the driver gets their names only.
    """
    folder = f"{path}.{uuid.uuid4().hex}"
    try:
        rows = df.select(F.concat_ws("\t", *map(field_text, df.schema.fields)).alias("row"))
        rows.write.option("compression", "gzip" if pack else "none").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(f"file://{folder}")
        found = sorted((tuple(map(int, m.groups())), f"{folder}/{m.string}") for m in map(re.compile(r"part-(\d+)-.*-c(\d+)\.txt(?:\.gz)?$").match, os.listdir(folder)) if m)
        files = [f for _, f in found]
        return placed(df.sparkSession, path, packed(df.sparkSession, files, pack) if pack else [(f, os.path.getsize(f)) for f in files], at)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_dump(path: str, tables: dict[str, DataFrame], schema: str = "public", pack: Callable[[bytes], bytes] | None = None) -> str:
    """One plain dump; its rows are written by tasks, into a folder that the driver and the executors share.

    ``pack`` compresses bytes so that what it gives can follow one another in a file; the text is never on disk then.
    """
    path = os.path.abspath(path)
    with open(path, "wb") as f:

        def write(text: str) -> None:
            f.write(pack(text.encode()) if pack else text.encode())

        write(HEAD + "".join(create_table(schema, name, [(c.name, pg_type(c.dataType)) for c in df.schema.fields]) for name, df in tables.items()))
        for name, df in tables.items():
            head, _, tail = copy_block(schema, name, df.columns, ()).partition("\\.\n")
            write(head)
            f.flush()
            f.seek(write_rows(path, df, f.tell(), pack))
            write("\\.\n" + tail)
        write("--\n-- PostgreSQL database dump complete\n--\n")
    return path
