"""Declared types, resolved to what a column is read as."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import types as T

from ..sources.copytext import IDENTIFIER, unquote
from ..sources.ddl import Column, Database


@dataclass(frozen=True)
class PgType:
    """kind names the decoder and the order; the rest are its parameters."""

    kind: str
    declared: str = ""
    args: tuple[int, ...] = ()
    element: PgType | None = None  # of arrays, ranges and multiranges
    fields: tuple[tuple[str, PgType], ...] = ()
    labels: tuple[str, ...] = ()
    exact: bool = True
    not_null: bool = False  # of a domain
    delimiter: str = ","
    dims: int = 1

    @property
    def nested(self) -> bool:
        return self.kind in ("array", "composite", "range", "multirange", "int2vector")


#: Names of built-in types, as written in DDL, and what they are.
NAMES = {
    "smallint": "int2", "int2": "int2", "integer": "int4", "int": "int4", "int4": "int4", "bigint": "int8", "int8": "int8", "oid": "oid",
    "boolean": "bool", "bool": "bool", "real": "float4", "float4": "float4", "double precision": "float8", "float8": "float8",
    "numeric": "numeric", "decimal": "numeric", "text": "text", "name": "text", "character varying": "varchar", "varchar": "varchar",
    "character": "bpchar", "char": "bpchar", "bpchar": "bpchar", "date": "date", "timestamp": "timestamp", "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz", "timestamptz": "timestamptz", "time": "time", "time without time zone": "time",
    "time with time zone": "timetz", "timetz": "timetz", "interval": "interval", "uuid": "uuid", "bytea": "bytea", "json": "json", "jsonb": "jsonb",
    "inet": "inet", "cidr": "cidr", "macaddr": "macaddr", "macaddr8": "macaddr8", "int2vector": "int2vector",
}
#: Built-in ranges and their subtypes; multiranges have the name with ``multi``.
RANGES = {"int4range": "integer", "int8range": "bigint", "numrange": "numeric", "tsrange": "timestamp without time zone", "tstzrange": "timestamp with time zone", "daterange": "date"}
MULTIRANGES = {name.replace("range", "multirange"): name for name in RANGES}
OPAQUE = "opaque"


def simple(kind: str, declared: str = "") -> PgType:
    return PgType(kind, declared or kind)


def resolve(declared: str, db: Database | None = None, depth: int = 0) -> PgType:
    """The type that a declaration names; what is not modelled is opaque text."""
    name = " ".join(declared.split())
    if depth > 16:
        return simple(OPAQUE, declared)
    m = re.match(r"^(.*?)((?:\s*\[\d*\])+|\s+ARRAY(?:\s*\[\d*\])?)$", name, re.I | re.S)
    if m and m[2].strip():
        element = resolve(m[1], db, depth + 1)
        base = db.find_type(*name_of(m[1])) if db and name_of(m[1]) else None
        if element.kind == OPAQUE or (base and base.kind == "domain" and element.kind == "array"):
            return simple(OPAQUE, declared)
        return PgType("array", declared, element=element, delimiter=base.delimiter if base else ",")
    lowered = name.lower()
    plain = re.sub(r"\s*\(([^)]*)\)", "", lowered).removeprefix("pg_catalog.")
    numbers = tuple(int(x) for x in re.findall(r"-?\d+", (re.search(r"\(([^)]*)\)", lowered) or [""])[0]))
    if plain.startswith("interval"):
        plain = "interval"
    if not name.startswith('"') and plain in NAMES:
        kind = NAMES[plain]
        if kind == "numeric" and numbers:
            p, s = numbers[0], numbers[1] if len(numbers) > 1 else 0
            # a scale over the precision, and negative ones, are kept exact by reading them as plain numeric
            return PgType("decimal" if s >= 0 and max(p, s) <= 38 else "numeric", declared, (p, s))
        if kind == "bpchar" and plain in ("character", "char") and not numbers:
            numbers = (1,)
        return PgType(kind, declared, numbers)
    if plain in RANGES:
        return PgType("range", declared, element=resolve(RANGES[plain]))
    if plain in MULTIRANGES:
        return PgType("multirange", declared, element=resolve(MULTIRANGES[plain]))
    key = name_of(name)
    found = db.find_type(*key) if db and key else None
    if found is None:
        return simple(OPAQUE, declared)
    if found.kind == "enum":
        return PgType("enum" if found.labels or found.exact else OPAQUE, declared, labels=tuple(found.labels), exact=found.exact)
    if found.kind == "domain":
        return replace(resolve(found.base, db, depth + 1), declared=declared, not_null=found.not_null)
    if found.kind == "composite":
        return PgType("composite", declared, fields=tuple((c.name, resolve(c.declared, db, depth + 1)) for c in found.fields))
    if found.kind == "range":
        return PgType("range", declared, element=resolve(found.subtype, db, depth + 1))
    if found.kind == "multirange":
        return PgType("multirange", declared, element=resolve(found.base, db, depth + 1))
    return simple(OPAQUE, declared)


def name_of(text: str) -> tuple[str | None, str] | None:
    m = re.fullmatch(rf"(?:({IDENTIFIER})\.)?({IDENTIFIER})", text.strip())
    return ((unquote(m[1]) if m[1] else None), unquote(m[2])) if m else None


SCALARS = {
    "int2": (T.ShortType(), pa.int16()), "int4": (T.IntegerType(), pa.int32()), "int8": (T.LongType(), pa.int64()), "oid": (T.LongType(), pa.int64()),
    "bool": (T.BooleanType(), pa.bool_()), "float4": (T.FloatType(), pa.float32()), "float8": (T.DoubleType(), pa.float64()), "date": (T.DateType(), pa.date32()),
    "timestamp": (T.TimestampNTZType(), pa.timestamp("us")), "timestamptz": (T.TimestampType(), pa.timestamp("us", "UTC")), "time": (T.LongType(), pa.int64()), "bytea": (T.BinaryType(), pa.binary()),
}
INTERVAL = ("months", "days", "nanos")


def spark_type(t: PgType) -> T.DataType:
    if t.kind in SCALARS:
        return SCALARS[t.kind][0]
    if t.kind == "decimal":
        return T.DecimalType(max(t.args), t.args[1])
    if t.kind == "interval":
        return T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())])
    if t.kind == "int2vector":
        return T.ArrayType(T.ShortType())
    if t.kind == "array":
        out = spark_type(t.element)
        for _ in range(t.dims):
            out = T.ArrayType(out)
        return out
    if t.kind == "composite" and t.fields:
        return T.StructType([T.StructField(n, spark_type(f)) for n, f in t.fields])
    if t.kind == "range":
        bound = spark_type(t.element)
        return T.StructType([T.StructField("lower", bound), T.StructField("upper", bound), *(T.StructField(n, T.BooleanType()) for n in ("lower_inclusive", "upper_inclusive", "empty"))])
    if t.kind == "multirange":
        return T.ArrayType(spark_type(t.element))
    return T.StringType()


def arrow_type(t: PgType) -> pa.DataType:
    if t.kind in SCALARS:
        return SCALARS[t.kind][1]
    if t.kind == "decimal":
        return pa.decimal128(max(t.args), t.args[1])
    if t.kind == "interval":
        return pa.struct([("months", pa.int32()), ("days", pa.int32()), ("nanos", pa.int64())])
    if t.kind == "int2vector":
        return pa.list_(pa.int16())
    if t.kind == "array":
        out = arrow_type(t.element)
        for _ in range(t.dims):
            out = pa.list_(out)
        return out
    if t.kind == "composite" and t.fields:
        return pa.struct([(n, arrow_type(f)) for n, f in t.fields])
    if t.kind == "range":
        bound = arrow_type(t.element)
        return pa.struct([("lower", bound), ("upper", bound), *((n, pa.bool_()) for n in ("lower_inclusive", "upper_inclusive", "empty"))])
    if t.kind == "multirange":
        return pa.list_(arrow_type(t.element))
    return pa.string()


@dataclass
class Resolved:
    """A column as it is read."""

    name: str
    type: PgType
    not_null: bool = False
    notes: list[str] = field(default_factory=list)

    def field(self) -> T.StructField:
        return T.StructField(self.name, spark_type(self.type), True, {"pg_type": self.type.declared, "kind": self.type.kind})


#: Collations under which bytes give the order.
BYTEWISE = {None, "C", "POSIX", "ucs_basic", "pg_c_utf8"}


def resolve_column(column: Column | None, name: str, db: Database, strings: bool = False, census: dict | None = None) -> Resolved:
    """``census``: least and most dimensions that a scan has seen, by column name; varying ones are read as text."""
    if strings or column is None:
        return Resolved(name, simple("text", "text" if column is None else column.declared), False, [] if strings else [f"{name}: not declared, read as text"])
    kind, notes = resolve(column.declared, db), []
    if kind.kind == OPAQUE:
        notes.append(f"{name}: {column.declared} is not modelled, read as text")
    if kind.kind == "array":
        low, high = (census or {}).get(name, (1, 1))
        if low != high and high:
            kind, notes = simple(OPAQUE, column.declared), [f"{name}: arrays of {low} to {high} dimensions, read as text"]
        else:
            kind = replace(kind, dims=max(1, high))
    if kind.kind in ("text", "varchar", "bpchar") and column.collation not in BYTEWISE:
        found = next((c for c in db.collations.values() if c.name == column.collation), None)
        notes.append(f"{name}: collation {column.collation} does not order by bytes" + ("" if found is None or found.deterministic else ", and calls different texts equal"))
    if kind.kind == "json":
        notes.append(f"{name}: json is compared as text")
    return Resolved(name, kind, column.not_null or kind.not_null, notes)
