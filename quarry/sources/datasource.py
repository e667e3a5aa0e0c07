"""``USING dump``: tables of a dump for Spark SQL, with filter pushdown into the scan."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

from ..errors import DumpError
from ..plans import predicate as P
from .rows import cut_block

OPTIONS = ("path", "table", "schema", "database", "schema_mode", "unrepresentable", "postgres_invalid_values", "inheritance", "strict_identity", "sidecar", "group_bytes")
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Types whose literals are printed as the database reads them.
PUSHED = ("int2", "int4", "int8", "oid", "text", "varchar", "date", "uuid", "bool", "float8", "decimal", "timestamp")


def literal(value) -> str:
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, Decimal):
        return f"{value:f}"
    return repr(value) if isinstance(value, float) else str(value)


class DumpSource(DataSource):
    """spark.read.format("dump").option("path", ...).option("table", ...)"""

    @classmethod
    def name(cls) -> str:
        return "dump"

    def _table(self):
        from ..operators.dump import Dump, DumpTable  # the planner's side of the package

        unknown = set(map(str.lower, self.options)) - set(OPTIONS)
        if unknown or "path" not in self.options or "table" not in self.options:
            raise DumpError(f"options are {OPTIONS}; path and table are needed; not {sorted(unknown)}")
        o = self.options
        # the planner's process has no session: a kept map is read, and one that is made is kept if there is a place for it
        dump = Dump(None, o["path"], o.get("sidecar"), tuple(o.get("strict_identity", "advisory").split(",")))
        database, key = dump.map.find(o["table"], o.get("schema"), o.get("database"))
        size = int(o["group_bytes"]) if "group_bytes" in o else None
        return DumpTable(dump, database, key, o.get("inheritance", "descendants"), o.get("schema_mode", "typed"), o.get("unrepresentable", "null"), o.get("postgres_invalid_values", "default"), size)

    def schema(self):
        from ..operators.scan import ScanSpec

        t = self._table()
        return ScanSpec(None, {}, {}, [], t.columns, t.modes).schema()

    def reader(self, schema):
        return DumpReader(self._table())

    def writer(self, schema, overwrite):
        raise DumpError("a dump is only read: rows can't be inserted")


class DumpReader(DataSourceReader):
    def __init__(self, table):
        from ..operators.scan import ScanSpec

        dump = table.dump
        segments = [s for b in table.blocks for s in cut_block(b, 32 << 20, dump.source.cuts())]
        self.spec = ScanSpec(dump.source, dump.map.identity, {b.number: b for b in table.blocks}, segments, table.columns, table.modes, watch=dump.identity_terms != ("none",))
        self.table, self.columns, self.strings = table, {c.name: c for c in table.columns}, table.strings

    def pushFilters(self, filters):
        terms = []
        for f in filters:
            term = self.term(f)
            if term is None:
                yield f  # stays with Spark
            else:
                terms.append(term)
        if terms:
            self.spec.filter = P.Bound(P.And(tuple(terms)), self.columns, strings=self.strings)
            names = P.columns_of(self.spec.filter.tree)
            if self.table.kept_statistics(names) is not None:  # row groups that can't hold such rows are not read
                self.spec.segments, self.spec.sortedness = self.table.pruned(self.spec.filter)

    def term(self, f):
        if isinstance(f, Not):
            inner = self.term(f.child)
            return None if inner is None else P.Not(inner)
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in self.columns or self.columns[name].type.kind not in PUSHED:
            return None
        if isinstance(f, IsNull):
            return P.Term(name, "is null")
        if isinstance(f, IsNotNull):
            return P.Term(name, "is not null")
        if isinstance(f, In):
            return P.Term(name, "in", tuple(None if v is None else literal(v) for v in f.value))
        if isinstance(f, EqualNullSafe):
            return P.Term(name, "is not distinct from", (None if f.value is None else literal(f.value),))
        op = COMPARISONS.get(type(f))
        return P.Term(name, op, (literal(f.value),)) if op and f.value is not None else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.spec.segments))] or [InputPartition(-1)]

    def read(self, partition):
        if partition.value < 0:
            return
        import pyarrow as pa

        names = [f.name for f in self.spec.schema().fields]
        for _, out in self.spec.read(self.spec.segments[partition.value]):
            yield pa.RecordBatch.from_arrays(out, names=names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DumpSource)


__all__ = ["DumpSource", "register"]
