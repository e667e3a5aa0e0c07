"""What a dump holds, without reading rows: as DataFrames, text or JSON."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame

from ..functions.pgtypes import resolve, spark_type
from .dump import Dump


def spans(dump: Dump) -> DataFrame:
    rows = [(s.start, s.end, s.kind, s.database, s.name, s.text) for s in dump.map.spans]
    return dump.spark.createDataFrame(rows, "start long, end long, kind string, database string, name string, text string")


def blocks(dump: Dump) -> DataFrame:
    rows = [(b.number, b.database, b.header.schema, b.header.table, list(b.header.columns or ()), b.start, b.data_start, b.data_end, b.end, b.partition_root) for b in dump.map.blocks]
    return dump.spark.createDataFrame(rows, "number int, database string, schema string, table string, columns array<string>, start long, data_start long, data_end long, end long, partition_root string")


def columns(dump: Dump) -> DataFrame:
    rows = []
    for name, db in dump.map.databases.items():
        for key in db.tables:
            for i, c in enumerate(db.all_columns(key)):
                t = resolve(c.declared, db)
                rows.append((name, *key, i, c.name, c.declared, t.kind, spark_type(t).simpleString(), c.not_null, c.collation, c.generated))
    return dump.spark.createDataFrame(rows, "database string, schema string, table string, position int, name string, declared string, kind string, spark_type string, not_null boolean, collation string, generated boolean")


def types(dump: Dump) -> DataFrame:
    rows = [(name, t.schema, t.name, t.kind, t.labels, [f"{c.name} {c.declared}" for c in t.fields], t.base, t.subtype) for name, db in dump.map.databases.items() for t in db.types.values()]
    return dump.spark.createDataFrame(rows, "database string, schema string, name string, kind string, labels array<string>, fields array<string>, base string, subtype string")


def object_kinds(dump: Dump) -> DataFrame:
    found = Counter((t["database"], t["type"]) for t in dump.map.toc)
    return dump.spark.createDataFrame([(d, k, n) for (d, k), n in sorted(found.items(), key=str)], "database string, kind string, n long")


def roles(dump: Dump) -> list[str]:
    return sorted({t["owner"] for t in dump.map.toc if t["owner"] and t["owner"] != "-"})


def report(dump: Dump, detail: bool = False) -> dict:
    out = {"location": dump.location, "size": dump.map.identity["size"], "databases": []}
    for name, db in dump.map.databases.items():
        mine = [b for b in dump.map.blocks if b.database == name]
        entry = {"name": name, "server": db.version, "extensions": db.extensions, "tables": len(db.tables), "types": len(db.types), "blocks": len(mine), "data_bytes": sum(b.data_end - b.data_start for b in mine)}
        if detail:
            entry["table_list"] = [{"schema": s, "name": t, "columns": [f"{c.name} {c.declared}" for c in db.all_columns((s, t))], "children": [".".join(map(str, k)) for k in db.children((s, t))]} for s, t in db.tables]
        out["databases"].append(entry)
    return out | {"roles": roles(dump), "spans": dict(Counter(s.kind for s in dump.map.spans))}


def text(dump: Dump, detail: bool = False) -> str:
    found = report(dump, detail)
    lines = [f"{found['location']}: {found['size']} bytes"]
    for d in found["databases"]:
        lines.append(f"database {d['name'] or '(unnamed)'}: {d['tables']} tables, {d['types']} types, {d['blocks']} blocks of {d['data_bytes']} bytes")
        lines += [f"  {t['schema']}.{t['name']} ({', '.join(t['columns'])})" for t in d.get("table_list", ())]
    return "\n".join([*lines, "spans: " + ", ".join(f"{k} {n}" for k, n in found["spans"].items())])


def as_json(dump: Dump, detail: bool = False) -> str:
    return json.dumps(report(dump, detail), indent=2)
