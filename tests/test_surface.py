"""Dialect rewrites, relational forms, reports, the command line, the data source and streams."""

import io
import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry import cli, typequeries
from quarry.errors import DumpError
from quarry.functions import scalars, tables
from quarry.operators import info, relational
from quarry.operators.dump import Dump, register_dump
from quarry.plans import dialect
from quarry.sources import datasource
from quarry.sources.writer import write_dump
from quarry.streaming import windows


def test_rewrites():
    assert dialect.rewrite("SELECT a FROM t ORDER BY a, b DESC, c NULLS FIRST LIMIT 3") == "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST, c NULLS FIRST LIMIT 3"
    assert "ORDER BY x" in dialect.rewrite("SELECT 'ORDER BY x' FROM t")
    assert dialect.rewrite('SELECT "A b" FROM t') == "SELECT `A b` FROM t"
    assert "RLIKE '^(?s:a.*)$'" in dialect.rewrite("SELECT 1 WHERE x SIMILAR TO 'a%'")


def test_dialect_runs(spark):
    spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, v int").createOrReplaceTempView("kv")
    assert [r.v for r in dialect.sql(spark, "SELECT v FROM kv ORDER BY v").collect()] == [2, 3, None]
    assert [r.v for r in dialect.sql(spark, "SELECT v FROM kv ORDER BY v DESC").collect()] == [None, 3, 2]
    assert {(r.k, r.v) for r in dialect.sql(spark, "SELECT DISTINCT ON (k) k, v FROM kv ORDER BY k, v DESC").collect()} == {(1, 3), (2, None)}
    assert dialect.sql(spark, "SELECT k, v FROM kv QUALIFY row_number() OVER (PARTITION BY k ORDER BY v) = 1").count() == 2
    assert dialect.sql(spark, "SELECT * FROM generate_series(1, 5) AS t(v)").count() == 5


def test_joins_on_ranges_and_times(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 99.0), (3, 250.5)], "id int, x double")
    right = spark.createDataFrame([("a", 0.0, 100.0), ("b", 90.0, 300.0)], "n string, low double, high double")
    assert {(r.id, r.n) for r in relational.range_join(left, right, "x", "low", "high", 50.0).collect()} == {(1, "a"), (2, "a"), (2, "b"), (3, "b")}
    trades = spark.createDataFrame([("x", 10), ("x", 20), ("y", 5)], "s string, t int")
    quotes = spark.createDataFrame([("x", 9, 1.0), ("x", 20, 2.0), ("y", 6, 3.0)], "s string, qt int, p double")
    assert {(r.s, r.t, r.p) for r in relational.as_of_join(trades, quotes, ["s"], "t", "qt", ["p"]).collect()} == {("x", 10, 1.0), ("x", 20, 2.0), ("y", 5, None)}


def test_any_and_all_with_nulls(spark):
    df, some = spark.createDataFrame([(1,), (5,)], "a int"), spark.createDataFrame([(2,), (None,)], "b int")
    assert [r.a for r in relational.compare_any(df, "a", ">", some).collect()] == [5]
    assert relational.compare_any(df, "a", ">", some, every=True).count() == 0
    assert relational.compare_any(df, "a", ">", some.limit(0), every=True).count() == 2


def test_scalars(spark):
    row = spark.range(1).select(scalars.gcd(F.lit(48), F.lit(-18)).alias("g"), scalars.lcm(F.lit(4), F.lit(6)).alias("l"), scalars.array_remove_n(F.array(*map(F.lit, [1, 2, 1, 1])), 1, 2).alias("r"), scalars.array_resize(F.array(F.lit(1)), 3, 0).alias("z")).first()
    assert (row.g, row.l, row.r, row.z) == (6, 12, [2, 1], [1, 0, 0])


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shop") / "shop.sql")
    return write_dump(path, {"item": spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, None, 1.0)], "id int, name string, price double")})


def test_reports(spark, shop):
    d = Dump(spark, shop)
    assert info.blocks(d).count() == 1 and info.columns(d).count() == 3 and info.types(d).count() == 0 and info.spans(d).count() > 2
    assert json.loads(info.as_json(d, True))["databases"][0]["table_list"][0]["name"] == "item" and "1 blocks" in info.text(d) and info.roles(d) == ["postgres"]
    assert {r.kind for r in info.object_kinds(d).collect()} == {"TABLE", "TABLE DATA"}


def test_command_line(spark, shop, tmp_path):
    def run(*argv):
        out = io.StringIO()
        assert cli.main(list(argv), spark, out) == 0
        return out.getvalue()

    assert run("query", "--source", shop, "--table", "item", "--column", "name", "--where", "price > 0 or id = 2") == "name\na\nb\n\\N\n"
    assert run("query", "--source", shop, "--table", "item", "--no-columns", "--filter", "id > 1") == "\n\n"
    assert run("sql", "--source", f"s={shop}", "--format", "csv", "-c", "SELECT count(*) AS n FROM s_public_item") == "n\n3\n"
    assert "item" in run("parse", shop, "--detail", "--sidecar", str(tmp_path / "side"))
    assert cli.source_option("x=/a/b.sql:strings:inheritance=only") == ("x", "/a/b.sql", {"schema_mode": "strings", "inheritance": "only"})


def test_table_functions(spark, tmp_path):
    tables.register(spark)
    spark.range(10).write.parquet(str(tmp_path / "p"))
    assert spark.sql(f"SELECT sum(rows) AS n FROM parquet_metadata('{tmp_path}/p')").first().n == 10
    assert spark.sql("SELECT count(*) AS n FROM generate_series(1, 9, 2)").first().n == 5


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def make_held(spark, tmp_path, rows=3000):
    df = spark.range(rows).selectExpr("id AS k", "array(id, id + 1) AS keys", "CAST(id AS DECIMAL(12,2)) AS price", "id % 2 = 0 AS even", "CAST(id AS DOUBLE) / 4 AS part", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS at")
    return df, write_dump(str(tmp_path / "held.sql"), {"held": df})


def test_data_source_reads_arrays_and_prunes_by_kept_statistics(spark, tmp_path):
    from quarry.sources import datasource

    df, path = make_held(spark, tmp_path)
    datasource.register(spark)
    plain = spark.read.format("dump").option("path", path).option("table", "held").load()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, df.collect()))  # no sidecar: the census is made on the spot
    side = str(tmp_path / "map")
    kept = Dump(spark, path, sidecar=side).table("held", group_bytes=8 << 10)
    kept.statistics()
    with_side = spark.read.format("dump").option("path", path).option("table", "held").option("sidecar", side).option("group_bytes", str(8 << 10)).load()
    for condition in ("price > 2990.50", "even AND k < 10", "part = 2.25", "at >= TIMESTAMP_NTZ '2032-01-01 00:00:00'", "NOT even AND price <= 3", "k IN (1, 5, 2999)"):
        assert sorted(r.k for r in with_side.where(condition).collect()) == sorted(r.k for r in df.where(condition).collect()), condition
    reader = datasource.DumpReader(kept)
    from pyspark.sql.datasource import EqualTo

    whole = len(reader.spec.segments)
    list(reader.pushFilters([EqualTo(("k",), 7)]))
    assert sum(s.end - s.start for s in reader.spec.segments) <= 2 * (8 << 10) and whole >= 1
    assert "table" not in pickle.loads(pickle.dumps(reader)).__dict__


def test_statistics_are_kept_once_a_column(spark, tmp_path):
    _, path = make_held(spark, tmp_path)
    side = str(tmp_path / "map")
    first, second = (Dump(spark, path, sidecar=side).table("held", group_bytes=8 << 10) for _ in range(2))
    first.statistics(["k"])
    before = {f: os.stat(os.path.join(side, f)).st_mtime_ns for f in os.listdir(side)}
    assert second.stats_aggregate(("count", None), ("max", "k")) == {"count": 3000, "max_k": 2999}
    second.statistics(["k", "price"])
    assert second.stats_aggregate(("count", None), ("sum", "price"))["count"] == 3000
    assert {f: os.stat(os.path.join(side, f)).st_mtime_ns for f in before if not f.startswith("stats")} == {f: t for f, t in before.items() if not f.startswith("stats")}
    assert [r["rows"] for r in second.kept_statistics(["k"])] and second.kept_statistics(["part"]) is None
    assert not [f for f in os.listdir(side) if f.count(".") > 1]  # nothing half written is left


def test_a_kept_map_runs_no_code(tmp_path):
    import pickle as p

    from quarry.operators.dump import MapReader

    class Evil:
        def __reduce__(self):
            return (os.mkdir, (str(tmp_path / "made"),))

    with pytest.raises(p.UnpicklingError):
        MapReader(io.BytesIO(p.dumps(Evil()))).load()
    assert not (tmp_path / "made").exists()


@pytest.mark.parametrize("form", ["table", "csv", "tsv", "json", "ndjson"])
def test_sql_prints_every_row(spark, form):
    out = io.StringIO()
    cli.main(["sql", "-c", "SELECT id, id * 2 AS twice FROM range(2500)", "--format", form], spark, out)
    text = out.getvalue()
    if form == "json":
        assert len(json.loads(text)) == 2500
    elif form == "ndjson":
        assert [json.loads(x)["id"] for x in text.split()] == list(range(2500))
    else:
        lines = text.rstrip("\n").split("\n")
        assert len(lines) == 2501 and lines[-1].replace(",", " ").split() == ["2499", "4998"]
    empty = io.StringIO()
    cli.main(["sql", "-c", "SELECT id FROM range(0)", "--format", form], spark, empty)
    assert json.loads(empty.getvalue()) == [] if form == "json" else "0" not in empty.getvalue()


def test_places_over_ranges(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "nullif(id % 7, 3) AS k").repartition(6)
    got = relational.numbered(df, [F.col("k").asc_nulls_last(), F.col("id").desc()], "place", str(tmp_path / "n"))
    want = sorted(((r.k is None, r.k or 0, -r.id, r.id) for r in df.collect()))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.place)] == [w[-1] for w in want] and got.agg(F.max("place")).first()[0] == 5000


def test_blocks_are_inflated_once_for_small_reads(tmp_path):
    import lzma

    from quarry.sources.byteio import open_source

    data = os.urandom(50_000)
    (tmp_path / "one.xz").write_bytes(lzma.compress(data))
    source = open_source(str(tmp_path / "one.xz"))
    calls, inflate = [], source.inflate
    source.inflate = lambda *a: calls.append(1) or inflate(*a)
    assert b"".join(source.read(a, a + 1000) for a in range(0, 50_000, 1000)) == data and len(calls) == 1
    del source.inflate
    again = pickle.loads(pickle.dumps(source))
    assert again.read(10, 20) == data[10:20] and source.cuts() is source.cuts()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "odd.sql")
    typequeries.write_odd(path)
    return path


def test_unrepresentable_in_sql(spark, odd):
    register_dump(spark, "q", odd)
    register_dump(spark, "plain", odd, schema_mode="strings")
    keys = lambda text: sorted(r.k for r in dialect.sql(spark, text).collect())
    assert keys("SELECT k FROM q_public_odd WHERE unrepresentable(v)") == [1, 3]
    assert keys("SELECT * FROM q_public_odd WHERE v IS NULL AND NOT Unrepresentable(\"v\")") == [2]
    assert keys("SELECT a.k FROM q_public_odd a JOIN q_public_odd b ON a.k = b.k WHERE unrepresentable(a.v) OR unrepresentable(b.n)") == [1, 3, 4]
    assert dialect.sql(spark, "SELECT * FROM q_public_odd WHERE unrepresentable(v)").columns == ["k", "v", "n"] == spark.table("q_public_odd").columns
    assert dialect.sql(spark, "SELECT 'unrepresentable(v)' AS s").first().s == "unrepresentable(v)"
    spark.range(3).selectExpr("id AS v").createOrReplaceTempView("no_dump")
    for text in ("SELECT v FROM no_dump WHERE unrepresentable(v)", "SELECT k FROM q_public_odd WHERE unrepresentable(k + 1)", "SELECT k FROM plain_public_odd WHERE unrepresentable(v)", "SELECT k FROM q_public_odd WHERE unrepresentable(nothing)"):
        with pytest.raises(DumpError):
            dialect.sql(spark, text)
    assert spark.table("q_public_odd").columns == ["k", "v", "n"]  # as it was


def test_strict_check(spark, odd, tmp_path):
    d = Dump(spark, odd)
    assert {(r.name, r.refused, r.nulls) for r in d.table("wrong").strict_check().collect()} == {("b", 2, 0), ("c", 0, 1)}
    assert d.table("odd").strict_check().count() == 0
    with pytest.raises(DumpError):
        d.table("odd", invalid="strict")
    out = io.StringIO()
    assert cli.main(["parse", odd, "--strict"], spark, out) == 1 and "wrong.b: 2 refused" in out.getvalue()


def test_levels_of_statistics(spark, odd, tmp_path):
    d = Dump(spark, odd, sidecar=str(tmp_path))
    d.gather("metadata", {"public.odd": "data", "public.odd.n": "metadata", "public.wrong.a": "data"})
    held = lambda table, column: d.table(table, inheritance="only").kept_statistics([column]) is not None
    assert held("odd", "k") and held("odd", "v") and held("wrong", "a")
    assert not held("odd", "n") and not held("wrong", "b") and not held("escapes", "k")
    for wrong in ({"public.odd": "some"}, {"public.none": "data"}):
        with pytest.raises(DumpError):
            d.gather("data", wrong)
    with pytest.raises(DumpError):
        Dump(spark, odd).gather()


@pytest.mark.parametrize("chunk", ["0", "7", "64"])
def test_pages_and_limits(spark, tmp_path, chunk):
    path = write_dump(str(tmp_path / "n.sql"), {"n": spark.range(0, 60, 1, 1).selectExpr("id", "id % 3 AS m")})
    spark.conf.set("quarry.chunk_size", chunk)
    try:
        t = Dump(spark, path).table("n")
        pages, token = [], None
        while True:
            rows, token = t.page(9, token, ["id"], where="m = 1")
            pages.append([r[0] for r in rows])
            if not token:
                break
        assert [x for p in pages for x in p] == list(range(1, 60, 3)) and [len(p) for p in pages] == [9, 9, 2]
        _, token = t.page(4, None, ["id"], where="m = 1")
        assert sorted(r.id for r in t.rest(token, ["id"], where="m = 1").collect()) == list(range(13, 60, 3))
        for other in ({"columns": ["id"], "where": "m = 2"}, {"columns": ["m"], "where": "m = 1"}):
            with pytest.raises(DumpError):
                t.page(4, token, **other)
        found = [r.id for r in t.scan(["id"], where="m = 1", limit=5).collect()]
        assert len(set(found)) == 5 and set(found) <= set(range(1, 60, 3))
        assert t.scan(limit=0).count() == 0 and t.scan(limit=1000).count() == 60 and t.scan([], limit=7).count() == 7
        assert t.page(0)[0] == []
    finally:
        spark.conf.unset("quarry.chunk_size")


@pytest.mark.parametrize("chunk", ["0", "10"])
def test_long_rows_are_refused(spark, tmp_path, chunk):
    path = write_dump(str(tmp_path / "long.sql"), {"t": spark.createDataFrame([(1, "a"), (2, "b" * 500), (3, "c")], "k int, v string")})
    spark.conf.set("quarry.chunk_size", chunk)
    try:
        spark.conf.set("quarry.memory", "503")
        assert Dump(spark, path).table("t").scan().count() == 3
        spark.conf.set("quarry.memory", "100")
        with pytest.raises(Exception, match="has over 100 bytes"):
            Dump(spark, path).table("t").scan().count()
        spark.conf.set("quarry.memory", "much")
        with pytest.raises(DumpError):
            Dump(spark, path).table("t").scan()
    finally:
        spark.conf.unset("quarry.memory")
        spark.conf.unset("quarry.chunk_size")


def test_ordered_values(spark):
    spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", None), (2, "d", 5)], "g int, v string, k int").createOrReplaceTempView("gvk")
    text = "SELECT g, first_value(v ORDER BY k) AS f, last_value(v ORDER BY k DESC) AS l, nth_value(v, 2 ORDER BY k) AS n FROM gvk GROUP BY g"
    assert {tuple(r) for r in dialect.sql(spark, text).collect()} == {(1, "b", "b", "a"), (2, "d", "d", None)}
    assert dialect.sql(spark, "SELECT first_value(v) OVER (PARTITION BY g ORDER BY k) AS f FROM gvk").count() == 4


def test_information_schema(spark, shop):
    register_dump(spark, "listed", shop)
    assert [r.table_type for r in dialect.sql(spark, "SELECT * FROM information_schema.tables WHERE table_name = 'listed_public_item'").collect()] == ["TEMPORARY"]
    found = dialect.sql(spark, "SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'listed_public_item' ORDER BY ordinal_position").collect()
    assert [tuple(r) for r in found] == [("id", "int"), ("name", "string"), ("price", "double")]
    assert {r.name for r in dialect.sql(spark, "SELECT * FROM information_schema.df_settings").collect()} == {"quarry.chunk_size", "quarry.memory"}


def test_dumps_are_read_only(spark, shop):
    datasource.register(spark)
    with pytest.raises(Exception, match="only read"):
        spark.createDataFrame([(4, "d", 1.0)], "id int, name string, price double").write.format("dump").mode("append").option("path", shop).option("table", "item").save()


def test_no_key_gets_a_sketch_of_its_own(spark):
    found = __spark_entry__.queries()["agg_approximate_error"](spark, "/root/testdata/sf0.001")
    assert "ObjectHashAggregate(keys=[l_orderkey" not in found._jdf.queryExecution().sparkPlan().toString()
    assert tuple(found.first()) == (True, True)
