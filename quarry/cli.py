"""parse, info, query and sql on the command line: python -m quarry.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions import tables
from .operators import info
from .operators.dump import Dump, register_dump
from .operators.render import rendered, shown
from .plans import dialect


def source_option(text: str) -> tuple[str | None, str, dict]:
    """[NAME=]SOURCE[:strings][:unrepresentable=MODE][:postgres-invalid-values=MODE][:inheritance=MODE]"""
    modes, parts = {}, text.split(":")
    while len(parts) > 1 and (parts[-1] == "strings" or parts[-1].partition("=")[0] in ("unrepresentable", "postgres-invalid-values", "inheritance", "strict-identity")):
        name, _, value = parts.pop().partition("=")
        key = {"strings": "schema_mode", "postgres-invalid-values": "invalid", "strict-identity": "identity"}.get(name, name)
        modes[key] = value or "strings"
    rest = ":".join(parts)
    name, eq, location = rest.partition("=")
    return (name, location, modes) if eq and name.isidentifier() else (None, rest, modes)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    top = argparse.ArgumentParser(prog="quarry")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("parse", "info"):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("--sidecar")
        p.add_argument("--detail", action="store_true")
        p.add_argument("--json", action="store_true")
        if name == "parse":
            p.add_argument("--statistics-level", default="data", choices=("data", "metadata"))
            p.add_argument("--statistics-override", action="append", default=[], metavar="TABLE[.COLUMN]=LEVEL")
            p.add_argument("--strict", action="store_true")
    q = commands.add_parser("query")
    q.add_argument("--source", required=True)
    q.add_argument("--table", required=True)
    q.add_argument("--database")
    q.add_argument("--column", action="append")
    q.add_argument("--no-columns", action="store_true")
    q.add_argument("--filter", action="append", default=[])
    q.add_argument("--where")
    q.add_argument("--semantics", default="postgres")
    s = commands.add_parser("sql")
    s.add_argument("--source", action="append", default=[])
    s.add_argument("-c", "--command-text", action="append", required=True)
    s.add_argument("--format", default="table")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    if args.command in ("parse", "info"):
        dump = Dump(spark, args.source, sidecar=args.sidecar)
        print(info.as_json(dump, args.detail) if args.json else info.text(dump, args.detail), file=out)
        if args.command == "parse" and args.sidecar:
            dump.gather(args.statistics_level, dict(o.rpartition("=")[::2] for o in args.statistics_override))
        if args.command == "parse" and args.strict:
            refused = 0
            for database, schema, name in dump.tables():
                for r in dump.table(name, schema, database, inheritance="only").strict_check().orderBy("name").toLocalIterator():
                    refused += 1
                    print(f"{name}.{r.name}: {r.refused} refused, {r.nulls} NULL where there may be none: {r.first}", file=out)
            return 1 if refused else 0
        return 0
    if args.command == "query":
        _, location, modes = source_option(args.source)
        identity = modes.pop("identity", "advisory")
        table = Dump(spark, location, identity=tuple(identity.split(","))).table(args.table, database=args.database, **modes)
        names = [] if args.no_columns else args.column or table.names
        if names:
            print("\t".join(names), file=out)
        for row in rendered(table, names, filters=args.filter, where=args.where, semantics=args.semantics).toLocalIterator():
            print(row.line, file=out)
        return 0
    tables.register(spark)
    for n, text in enumerate(args.source):
        name, location, modes = source_option(text)
        identity = modes.pop("identity", "advisory")
        register_dump(spark, name or f"dump{n or ''}", location, identity=tuple(identity.split(",")), **modes)
    for text in args.command_text:
        for lines in shown(dialect.sql(spark, text), args.format):  # every row, whatever their number
            print(lines, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
