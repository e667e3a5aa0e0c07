"""Registered queries over the types of a dump: decoders, comparisons, and loads that few dumps have.

The literals are read from a small dump by the library, and parsed from the same texts by SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators.dump import Dump, register_dump
from .plans import dialect
from .sources.writer import HEAD, copy_block, create_table

TYPE_DDL = "CREATE TYPE public.mood AS ENUM (\n    'sad',\n    'fine',\n    'glad'\n);\n\nCREATE TYPE public.spot AS (\n    x integer,\n    y text\n);\n\n"

#: name: (declared type, literals, columns for Spark, the same for SQL over the literal ``v``)
DECODED: dict[str, tuple[str, tuple, tuple[str, ...], tuple[str, ...]]] = {
    "types_bool": ("boolean", ("t", "f", None), ("v",), ("v = 't' AS v",)),
    "types_smallint": ("smallint", ("-32768", "0", "32767", None), ("CAST(v AS INT) AS v",), ("CAST(v AS INT) AS v",)),
    "types_oid": ("oid", ("0", "4294967295", "77"), ("v",), ("CAST(v AS BIGINT) AS v",)),
    "types_float": ("double precision", ("0.25", "-1e-05", "1.7976931348623157e+308", "3", None), ("v",), ("CAST(v AS DOUBLE) AS v",)),
    "types_real": ("real", ("0.5", "-1024.25", "8388608"), ("CAST(v AS DOUBLE) AS v",), ("CAST(CAST(v AS REAL) AS DOUBLE) AS v",)),
    "types_decimal": ("numeric(12,3)", ("1.5", "-0.001", "999999999.999", "7", "1.2345", None), ("CAST(v AS STRING) AS v",), ("CAST(CAST(v AS DECIMAL(12,3)) AS VARCHAR) AS v",)),
    "types_numeric": ("numeric", ("1.50", "-123456789012345678901234567890.125", "0"), ("v",), ("v",)),
    "types_date": ("date", ("2024-02-29", "0001-01-01", "1900-03-01", "9999-12-31", None), ("v",), ("CAST(v AS DATE) AS v",)),
    "types_time": ("time without time zone", ("00:00:00", "23:59:59.000001", "12:30:15.25"), ("v",), ("CAST(extract(HOUR FROM CAST(v AS TIME)) * 3600000000 + extract(MINUTE FROM CAST(v AS TIME)) * 60000000 + extract(MICROSECOND FROM CAST(v AS TIME)) AS BIGINT) AS v",)),
    "types_timestamp": ("timestamp without time zone", ("2024-02-29 12:00:00", "1969-12-31 23:59:59.999999", "2038-01-19 03:14:08.5", None), ("v",), ("CAST(v AS TIMESTAMP) AS v",)),
    "types_timestamptz": ("timestamp with time zone", ("2024-07-01 00:00:00+00", "2024-07-01 05:30:00+05:30", "1970-01-01 00:00:00-08"), ("unix_micros(v) AS v",), ("epoch_us(CAST(v AS TIMESTAMPTZ)) AS v",)),
    "types_interval": ("interval", ("1 year 2 mons 3 days 04:05:06.5", "-5 days", "00:00:00.25", "10 mons"), ("v.months", "v.days", "v.nanos"), ("CAST(date_part('year', CAST(v AS INTERVAL)) * 12 + date_part('month', CAST(v AS INTERVAL)) AS INT) AS months", "CAST(date_part('day', CAST(v AS INTERVAL)) AS INT) AS days", "CAST((date_part('hour', CAST(v AS INTERVAL)) * 3600000000 + date_part('minute', CAST(v AS INTERVAL)) * 60000000 + date_part('microsecond', CAST(v AS INTERVAL))) * 1000 AS BIGINT) AS nanos")),
    "types_uuid": ("uuid", ("0F0E0D0C-0B0A-0908-0706-050403020100", "ffffffff-ffff-4fff-8fff-ffffffffffff"), ("v",), ("CAST(CAST(v AS UUID) AS VARCHAR) AS v",)),
    "types_bytea": ("bytea", ("\\x00ff10", "\\x", "\\xCAFE"), ("lower(hex(v)) AS v",), ("lower(hex(unhex(substr(v, 3)))) AS v",)),
    "types_text": ("text", ("tab\there", "line\nfeed", "back\\slash", "", "naïve ☃", None), ("v", "length(v) AS n"), ("v", "CAST(length(v) AS INT) AS n")),
    "types_padded": ("character(6)", ("ab", "abcdef", " x"), ("v",), ("rpad(v, 6, ' ') AS v",)),
    "types_varchar": ("character varying(4)", ("abcd", "é☃", ""), ("v",), ("v",)),
    "types_inet": ("inet", ("10.1.2.3", "10.1.2.0/24", "2001:db8::7"), ("v",), ("v",)),
    "types_macaddr": ("macaddr", ("0a:1b:2c:3d:4e:5f", "00:00:00:00:00:01"), ("v",), ("v",)),
    "types_json": ("json", ('{"a": 5, "b": [1, 2]}', '{"a": "x\\\\y"}', '{"c": null}'), ("get_json_object(v, '$.a') AS a",), ("json_extract_string(v, '$.a') AS a",)),
    "types_int_array": ("integer[]", ("{1,NULL,3}", "{}", "{-7}", None), ("v",), ("CAST(translate(v, '{}', '[]') AS INT[]) AS v",)),
    "types_text_array": ("text[]", ("{ab,c}", '{"d e",f}', "{}"), ("array_join(v, '|') AS v", "size(v) AS n"), ("array_to_string(string_split(replace(substr(v, 2, length(v) - 2), '\"', ''), ','), '|') AS v", "CAST(CASE WHEN v = '{}' THEN 0 ELSE len(string_split(v, ',')) END AS INT) AS n")),
    "types_record": ("public.spot", ("(1,north)", "(,west)", '(7,"far east")'), ("v.x", "v.y"), ("try_cast(split_part(substr(v, 2), ',', 1) AS INT) AS x", "trim(rtrim(split_part(v, ',', 2), ')'), '\"') AS y")),
    "types_range": ("int4range", ("[1,5)", "[3,4)", "[-9,100)"), ("v.lower", "v.upper", "v.lower_inclusive AS li", "v.upper_inclusive AS ui"), ("CAST(regexp_extract(v, '.(-?[0-9]+),', 1) AS INT) AS lower", "CAST(regexp_extract(v, ',([0-9]+)', 1) AS INT) AS upper", "v[1] = '[' AS li", "v[-1] = ']' AS ui")),
    "types_int2vector": ("int2vector", ("1 -2 3", "5", ""), ("array_join(v, ' ') AS v",), ("v",)),
    "types_enum": ("public.mood", ("glad", "sad", None), ("v",), ("v",)),
}

#: name: (declared type, literals, condition, the same in SQL over the literal ``v``)
COMPARED: dict[str, tuple[str, tuple, str, str]] = {
    "cmp_oid": ("oid", ("5", "4294967295", "2147483648", "10"), "v > 2147483647", "CAST(v AS BIGINT) > 2147483647"),
    "cmp_float_nan": ("double precision", ("NaN", "Infinity", "1", "-Infinity", None), "v > 1", "CAST(v AS DOUBLE) > 1"),
    "cmp_decimal": ("numeric(10,2)", ("1.00", "1.01", "-5", "10", None), "v >= 1.01", "CAST(v AS DECIMAL(10,2)) >= 1.01"),
    "cmp_numeric": ("numeric", ("1.0", "1.00", "10", "9.99", "-1"), "v = 1", "CAST(v AS DECIMAL(20,5)) = 1"),
    "cmp_date": ("date", ("2024-01-31", "2023-12-31", "2024-02-01", None), "v < '2024-02-01'", "CAST(v AS DATE) < DATE '2024-02-01'"),
    "cmp_time": ("time without time zone", ("09:00:00", "10:00:00.5", "10:00:00"), "v > '10:00:00'", "CAST(v AS TIME) > TIME '10:00:00'"),
    "cmp_timetz": ("time with time zone", ("12:00:00+00", "13:00:00+02", "12:00:00-01"), "v > '12:00:00+00'", "v = '12:00:00-01'"),
    "cmp_timestamp": ("timestamp without time zone", ("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00", "2023-06-01 00:00:00"), "v > '2024-01-01 00:00:00'", "CAST(v AS TIMESTAMP) > TIMESTAMP '2024-01-01 00:00:00'"),
    "cmp_timestamptz": ("timestamp with time zone", ("2024-01-01 01:00:00+01", "2024-01-01 00:00:00+00", "2024-01-01 00:00:00+01"), "v = '2024-01-01 00:00:00+00'", "epoch_us(CAST(v AS TIMESTAMPTZ)) = epoch_us(TIMESTAMPTZ '2024-01-01 00:00:00+00')"),
    "cmp_interval": ("interval", ("1 mon", "30 days", "29 days 23:59:59", "31 days", "720:00:00"), "v = '30 days'", "CAST(v AS INTERVAL) = INTERVAL '30 days'"),
    "cmp_uuid": ("uuid", ("00000000-0000-0000-0000-000000000001", "80000000-0000-0000-0000-000000000000", "7fffffff-0000-0000-0000-000000000000"), "v > '7fffffff-0000-0000-0000-000000000000'", "lower(v) > '7fffffff-0000-0000-0000-000000000000'"),
    "cmp_bytea": ("bytea", ("\\x00", "\\x0001", "\\xff", "\\x"), "v > '\\x00'", "unhex(substr(v, 3)) > unhex('00')"),
    "cmp_padded": ("character(4)", ("ab", "ab  ", "abc", "aa"), "v = 'ab'", "rtrim(v) = 'ab'"),
    "cmp_enum": ("public.mood", ("glad", "sad", "fine", None), "v >= 'fine'", "list_position(['sad', 'fine', 'glad'], v) >= 2"),
    "cmp_inet": ("inet", ("10.0.0.1", "10.0.0.0/8", "9.255.0.1", "11.0.0.0"), "v > '10.0.0.1'", "v = '11.0.0.0'"),
    "cmp_macaddr": ("macaddr", ("00:00:00:00:00:0a", "00:00:00:00:00:09", "ff:00:00:00:00:00"), "v > '00:00:00:00:00:09'", "v > '00:00:00:00:00:09'"),
    "cmp_jsonb": ("jsonb", ('{"a": 1}', "3", '"x"', "[1, 2]", "null"), "v = '{\"a\": 1.0}'", "v = '{\"a\": 1}'"),
    "cmp_array": ("integer[]", ("{1,2}", "{1,3}", "{1}", "{2}"), "v > '{1,2}'", "CAST(translate(v, '{}', '[]') AS INT[]) > [1, 2]"),
    "cmp_range": ("int4range", ("[1,5)", "[1,4]", "[1,6)", "[2,3)"), "v = '[1,5)'", "v IN ('[1,5)', '[1,4]')"),
    "cmp_interval_between": ("interval", ("1 day", "23:59:59", "25:00:00", "2 days"), "v >= '1 day' and v < '2 days'", "CAST(v AS INTERVAL) >= INTERVAL '1 day' AND CAST(v AS INTERVAL) < INTERVAL '2 days'"),
}


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def literals(values: tuple) -> str:
    rows = ", ".join(f"({k}, {quoted(v)})" for k, v in enumerate(values))
    return f"(VALUES {rows}) AS t(k, v)"


def write_types(path: str) -> None:
    with open(path, "w", newline="\n") as f:
        f.write(HEAD + TYPE_DDL)
        tables = {n: (t[0], t[1]) for n, t in (DECODED | COMPARED).items()}
        for name, (declared, _) in tables.items():
            f.write(create_table("public", name, [("k", "integer"), ("v", declared)]))
        for name, (_, rows) in tables.items():
            f.write(copy_block("public", name, ["k", "v"], enumerate(rows)))


def write_several(path: str) -> None:
    """A script of two databases, each with a table ``things``."""
    with open(path, "w", newline="\n") as f:
        f.write("--\n-- PostgreSQL database cluster dump\n--\n\n")
        for name, rows in (("first", [(1, "a"), (2, "b")]), ("second", [(3, "c")])):
            f.write(f"--\n-- Database \"{name}\" dump\n--\n\n\\connect {name}\n\n{HEAD}")
            f.write(create_table("public", "things", [("k", "integer"), ("v", "text")]))
            f.write(copy_block("public", "things", ["k", "v"], rows))


def write_root(path: str) -> None:
    """A partitioned table whose rows were dumped through its root."""
    with open(path, "w", newline="\n") as f:
        f.write(HEAD + "CREATE TABLE public.log (\n    k integer NOT NULL,\n    v text\n)\nPARTITION BY RANGE (k);\n\n")
        f.write(create_table("public", "log_low", [("k", "integer NOT NULL"), ("v", "text")]))
        f.write("ALTER TABLE ONLY public.log ATTACH PARTITION public.log_low FOR VALUES FROM (0) TO (10);\n\n")
        block = copy_block("public", "log", ["k", "v"], [(1, "low"), (9, "top")])
        f.write(block.replace("Data for Name: log;", "Data for Name: log_low;").replace("COPY public.log", "-- load via partition root public.log\nCOPY public.log"))


def write_odd(path: str) -> None:
    """Values that no column's type holds, values that their declared type refuses, and every escape."""
    with open(path, "w", newline="\n") as f:
        f.write(HEAD)
        tables = {
            "odd": ([("k", "integer"), ("v", "date"), ("n", "numeric(6,2)")], [(1, "infinity", "1.5"), (2, None, "2"), (3, "-infinity", None), (4, "2024-05-06", "NaN"), (5, "2024-05-07", "0")]),
            "wrong": ([("a", "integer"), ("b", "integer"), ("c", "text NOT NULL")], [(1, "x", "u"), (2, "99999999999", None), (3, "3", "w")]),
        }
        for name, (columns, _) in tables.items():
            f.write(create_table("public", name, columns))
        f.write(create_table("public", "escapes", [("k", "integer"), ("v", "text")]))
        for name, (columns, rows) in tables.items():
            f.write(copy_block("public", name, [n for n, _ in columns], rows))
        head, _, tail = copy_block("public", "escapes", ["k", "v"], ()).partition("\\.\n")
        f.write(head + "1\ta\\tb\\nc\\\\d\n2\t\\x41\\132\\b\\f\\v\\r\n3\t\\N\n4\t\n5\t\\\\N\n\\.\n" + tail)


def registered(dump_path: Callable) -> tuple[dict[str, Callable], dict[str, str]]:
    """The queries and their SQL; ``dump_path(spark, folder, kind, make)`` gives the path of a written dump."""
    queries, oracles = {}, {}

    def of(spark, d) -> Dump:
        return Dump(spark, dump_path(spark, d, "types", write_types))

    def decoded(name: str, exprs: tuple[str, ...]):
        return lambda spark, d: of(spark, d).table(name).scan().selectExpr("k", *exprs)

    def compared(name: str, condition: str):
        return lambda spark, d: of(spark, d).table(name).scan(["k"], where=condition)

    for name, (_, rows, exprs, sql) in DECODED.items():
        queries[name] = decoded(name, exprs)
        oracles[name] = f"SELECT k, {', '.join(sql)} FROM {literals(rows)}"
    for name, (_, rows, condition, sql) in COMPARED.items():
        queries[name] = compared(name, condition)
        oracles[name] = f"SELECT k FROM {literals(rows)} WHERE {sql}"

    def several_databases(spark, d) -> DataFrame:
        both = Dump(spark, dump_path(spark, d, "several", write_several))
        found = [both.table("things", database=n).scan().selectExpr(f"'{n}' AS db", "k", "v") for n in ("first", "second")]
        return found[0].unionByName(found[1])

    queries["dump_databases"] = several_databases
    oracles["dump_databases"] = "SELECT * FROM (VALUES ('first', 1, 'a'), ('first', 2, 'b'), ('second', 3, 'c')) AS t(db, k, v)"
    def held(spark, d) -> DataFrame:
        register_dump(spark, "odd", dump_path(spark, d, "odd", write_odd))
        return dialect.sql(spark, "SELECT k FROM odd_public_odd WHERE v IS NULL AND NOT unrepresentable(v) OR unrepresentable(odd_public_odd.n)")

    def refused(spark, d) -> DataFrame:
        return Dump(spark, dump_path(spark, d, "odd", write_odd)).table("wrong").strict_check().select("name", "refused", "nulls")

    def escaped(spark, d) -> DataFrame:
        return Dump(spark, dump_path(spark, d, "odd", write_odd)).table("escapes").scan()

    queries["sql_unrepresentable"] = held
    oracles["sql_unrepresentable"] = "SELECT k FROM (VALUES (2), (4)) AS t(k)"
    queries["filter_unrepresentable"] = lambda spark, d: Dump(spark, dump_path(spark, d, "odd", write_odd)).table("odd").scan(["k"], where="v is unrepresentable")
    oracles["filter_unrepresentable"] = "SELECT k FROM (VALUES (1), (3)) AS t(k)"
    queries["stats_strict"] = refused
    oracles["stats_strict"] = "SELECT * FROM (VALUES ('b', CAST(2 AS BIGINT), CAST(0 AS BIGINT)), ('c', 0, 1)) AS t(name, refused, nulls)"
    queries["dump_escapes"] = escaped
    oracles["dump_escapes"] = "SELECT 1 AS k, 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(92) || 'd' AS v UNION ALL SELECT 2, 'AZ' || chr(8) || chr(12) || chr(11) || chr(13) UNION ALL SELECT 3, NULL UNION ALL SELECT 4, '' UNION ALL SELECT 5, chr(92) || 'N'"
    queries["partition_root"] = lambda spark, d: Dump(spark, dump_path(spark, d, "root", write_root)).table("log").scan()
    oracles["partition_root"] = "SELECT * FROM (VALUES (1, 'low'), (9, 'top')) AS t(k, v)"
    return queries, oracles
