"""Registered queries of the library's own operators, with the SQL that says the same.

``dump_*``, ``filter_*``, ``prune_*``, ``stats_*`` and ``table_*`` read a dump that is written once from the Parquet
tables; the others show the query surface over the tables themselves, through the dialect rewrites.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import typequeries
from .errors import DumpError
from .functions import scalars, tables
from .operators import info, relational
from .operators.dump import Dump, register_dump
from .plans import dialect
from .plans.predicate import Term, between, is_truth
from .sources import datasource
from .sources.writer import HEAD, copy_block, create_table, write_dump
from .streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DUMPED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose text, after the rewrites, is Spark's."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                read(spark, sf_dir, t).createOrReplaceTempView(t)
        return dialect.sql(spark, sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or sql


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and the executors see: on a cluster, spark.checkpoint.dir has to name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise DumpError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = urlsplit(named or tempfile.gettempdir()).path
    folder = os.path.join(at, "quarry-dumps")
    os.makedirs(folder, exist_ok=True)
    return folder


def input_state(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """Size and time of each table that is dumped, by Spark's file systems."""
    out = []
    for name in DUMPED:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        out.append((files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
    return out


def dump_path(spark: SparkSession, sf_dir: str, kind: str = "all", make=None) -> str:
    """Write the dump of a folder's tables unless it is there for these inputs; a finished file has its final name."""
    tag = hashlib.sha256(f"{sf_dir} {kind} 3 {input_state(spark, sf_dir)}".encode()).hexdigest()[:16]
    path = os.path.join(shared_folder(spark), f"{kind}-{tag}.sql")
    if not os.path.exists(path):
        part = f"{path}.{os.getpid()}"
        (make or (lambda p: write_dump(p, {t: read(spark, sf_dir, t) for t in DUMPED})))(part)
        os.replace(part, path)
    return path


def dump(spark: SparkSession, sf_dir: str, **options) -> Dump:
    return Dump(spark, dump_path(spark, sf_dir), **options)


#: Bytes of a row group in the queries: the tables here are small.
GROUP_BYTES = 64 << 10


def mapped(spark: SparkSession, sf_dir: str) -> Dump:
    """The dump with its map and the statistics of its large tables, gathered once and kept beside it."""
    path = dump_path(spark, sf_dir)
    found = Dump(spark, path, sidecar=f"{path}.map")
    for name in ("orders", "lineitem", "customer"):
        found.table(name, group_bytes=GROUP_BYTES).statistics()
    return found


# ---- scans ------------------------------------------------------------------------------------------


@query("SELECT * FROM region")
def dump_scan_region(spark, d):
    return dump(spark, d).table("region").scan()


@query("SELECT * FROM nation")
def dump_scan_nation(spark, d):
    return dump(spark, d).table("nation", "public").scan()


@query("SELECT * FROM orders")
def dump_scan_orders(spark, d):
    return dump(spark, d).table("public.orders").scan(segment_bytes=1 << 20)


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def dump_scan_projection(spark, d):
    return dump(spark, d).table("lineitem").scan(["l_orderkey", "l_extendedprice"], segment_bytes=4 << 20)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def dump_scan_strings(spark, d):
    return dump(spark, d).table("nation", schema_mode="strings").scan()


@query("SELECT count(*) AS n FROM lineitem")
def dump_scan_count_only(spark, d):
    return dump(spark, d).table("lineitem").scan([]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def dump_scan_events_json(spark, d):
    return dump(spark, d).table("events").scan()


def numbered(spark, d, df: DataFrame, by: list, name: str) -> DataFrame:
    out = os.path.join(shared_folder(spark), f"numbered-{uuid.uuid4().hex}")
    return relational.numbered(df, by, name, out)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def dump_scan_file_order(spark, d):
    found = dump(spark, d).table("orders").scan(["o_orderkey"], offsets=True)
    return numbered(spark, d, found, ["_offset"], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 500 AND o_orderstatus IN ('O', 'F')")
def dump_data_source(spark, d):
    datasource.register(spark)
    path = dump_path(spark, d)
    Dump(spark, path, sidecar=f"{path}.map")  # mapped by tasks, as the planner would do it alone
    t = spark.read.format("dump").option("path", path).option("table", "orders").option("sidecar", f"{path}.map").load()
    return t.where("o_orderkey BETWEEN 10 AND 500 AND o_orderstatus IN ('O', 'F')").select("o_orderkey", "o_totalprice")


def arrays_dump(spark, d) -> str:
    def make(part: str) -> None:
        rows = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("keys"), F.max("c_acctbal").cast("decimal(12,2)").alias("best"))
        write_dump(part, {"held": rows})

    return dump_path(spark, d, "held", make)


@query("SELECT c_nationkey, list_sort(list(c_custkey)) AS keys FROM customer GROUP BY c_nationkey HAVING CAST(max(c_acctbal) AS DECIMAL(12,2)) > 100.50")
def dump_data_source_arrays(spark, d):
    """A table with an array column, through SQL's own DDL; a decimal bound is pushed into the scan."""
    datasource.register(spark)
    path = arrays_dump(spark, d)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW held_accounts USING dump OPTIONS (path '{path}', table 'held', sidecar '{path}.map')")
    return spark.sql("SELECT c_nationkey, keys FROM held_accounts WHERE best > 100.50")


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def dump_register_views(spark, d):
    register_dump(spark, "shop", dump_path(spark, d))
    return spark.sql("SELECT r_name, count(*) AS n FROM shop_public_region JOIN shop_public_nation ON r_regionkey = n_regionkey GROUP BY r_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def dump_staged_parquet(spark, d):
    path = os.path.join(shared_folder(spark), "staged-orders-" + hashlib.sha256(d.encode()).hexdigest()[:12])
    staged = dump(spark, d).table("orders").stage(path, partition_by=["o_orderstatus"])
    return staged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def compressed(spark, d, kind: str, pack, **options) -> Dump:
    """The dump in streams or members of 4 MiB, which tasks make."""
    return Dump(spark, dump_path(spark, d, kind, lambda part: write_dump(part, {t: read(spark, d, t) for t in DUMPED}, pack=pack)), **options)


@query("SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def dump_scan_xz(spark, d):
    import lzma

    t = compressed(spark, d, "xz", lambda data: lzma.compress(data, preset=1)).table("orders")
    return t.scan(["o_orderkey"], segment_bytes=1 << 20).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer")
def dump_scan_gzip(spark, d):
    import gzip

    source = compressed(spark, d, "gz", lambda data: gzip.compress(data, mtime=0), spool_to=shared_folder(spark))
    return source.table("customer").scan(["c_custkey"]).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("SELECT least(count(*), 1000) AS n FROM lineitem")
def dump_limit(spark, d):
    """Any 1000 rows: no task decodes more."""
    return dump(spark, d).table("lineitem").scan(["l_orderkey"], limit=1000).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def dump_resume(spark, d):
    """Two pages of a query, and the rest of it from the second one's token on."""
    t, asked = dump(spark, d).table("orders"), {"columns": ["o_orderkey"], "where": "o_orderstatus = O"}
    first, token = t.page(100, **asked)
    second, token = t.page(150, token, **asked)
    return t.rest(token, **asked).union(spark.createDataFrame([*first, *second], "o_orderkey long"))


@query("SELECT o_orderkey, o_orderdate FROM orders")
def dump_small_chunks(spark, d):
    """The session's settings: the bytes that a task reads at a time, and the longest row that is read."""
    dialect.sql(spark, "SET quarry.chunk_size = 131072")
    dialect.sql(spark, "SET quarry.memory = 65536")
    try:
        return dump(spark, d).table("orders").scan(["o_orderkey", "o_orderdate"])
    finally:
        dialect.sql(spark, "RESET quarry.chunk_size")
        dialect.sql(spark, "RESET quarry.memory")


@query("SELECT 'quarry_listed_public_region' AS table_name, 'r_name' AS column_name, 2 AS ordinal_position, 'string' AS data_type")
def information_schema(spark, d):
    register_dump(spark, "quarry_listed", dump_path(spark, d))
    return dialect.sql(spark, "SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'quarry_listed_public_region' AND column_name = 'r_name'")


# ---- files as tables --------------------------------------------------------------------------------


def file_folder(d: str, spark: SparkSession, kind: str) -> str:
    return os.path.join(shared_folder(spark), f"{kind}-" + hashlib.sha256(d.encode()).hexdigest()[:12])


def as_files(kind: str, names: list[str], schema: str, **options):
    """The customers written as files of a kind, which SQL reads by their path."""

    def run(spark, d):
        path = file_folder(d, spark, f"files-{kind}")
        read(spark, d, "customer").select(*names).write.mode("overwrite").format(kind).options(**options).save(path)
        if kind == "orc":
            return spark.sql(f"SELECT {', '.join(names)} FROM orc.`{path}`")
        return spark.read.format(kind).schema(schema).options(**options).load(path)

    run.__name__ = f"file_{kind}"
    QUERIES[run.__name__], ORACLES[run.__name__] = run, f"SELECT {', '.join(names)} FROM customer"


for kind in ("csv", "json", "orc"):
    as_files(kind, ["c_custkey", "c_name", "c_mktsegment"], "c_custkey long, c_name string, c_mktsegment string", **({"header": "true"} if kind == "csv" else {}))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def file_partitions(spark, d):
    """Hive folders: the condition on the folder's column leaves two folders of three unread."""
    path = file_folder(d, spark, "folders-orders")
    read(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    return spark.sql(f"SELECT o_orderkey, o_orderstatus FROM parquet.`{path}` WHERE o_orderstatus = 'F'")


# ---- filters ----------------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_quantity"]


def filtered(name: str, where, sql: str, table: str = "lineitem", columns=LINE) -> None:
    def run(spark, d):
        options = {"where": where} if isinstance(where, str) else {"tree": where}
        return dump(spark, d).table(table).scan(columns, **options)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}"


filtered("filter_eq", "l_quantity = 10", "l_quantity = 10")
filtered("filter_ne", "l_returnflag != 'N'", "l_returnflag <> 'N'")
filtered("filter_lt", "l_orderkey < 100", "l_orderkey < 100")
filtered("filter_le", "l_shipdate <= '1995-06-17 00:00:00'", "l_shipdate <= TIMESTAMP '1995-06-17 00:00:00'")
filtered("filter_gt", "l_extendedprice > 90000.5", "l_extendedprice > 90000.5")
filtered("filter_ge", "l_returnflag >= R", "l_returnflag >= 'R'")
filtered("filter_and_or_not", "not (l_quantity < 25 or l_returnflag = 'A') and (l_linenumber = 1 or l_discount >= 0.05)", "NOT (l_quantity < 25 OR l_returnflag = 'A') AND (l_linenumber = 1 OR l_discount >= 0.05)")
filtered("filter_in", "l_linenumber in (1, 3, 99)", "l_linenumber IN (1, 3, 99)")
filtered("filter_not_in", "l_linenumber not in (1, 2, 3)", "l_linenumber NOT IN (1, 2, 3)")
filtered("filter_not_in_null", "l_linenumber not in (1, null)", "l_linenumber NOT IN (1, NULL)")
filtered("filter_in_empty", Term("l_linenumber", "in", ()), "false")
filtered("filter_between", between("l_quantity", "5", "7"), "l_quantity BETWEEN 5 AND 7")
filtered("filter_distinct_from", "c_mktsegment is distinct from 'BUILDING'", "c_mktsegment IS DISTINCT FROM 'BUILDING'", "customer", ["c_custkey"])
filtered("filter_not_distinct_from", "c_mktsegment is not distinct from 'BUILDING'", "c_mktsegment IS NOT DISTINCT FROM 'BUILDING'", "customer", ["c_custkey"])
filtered("filter_where_grammar", "NOT (c_nationkey > 5 AND c_acctbal < 0) OR c_mktsegment = 'MACHINERY'", "NOT (c_nationkey > 5 AND c_acctbal < 0) OR c_mktsegment = 'MACHINERY'", "customer", ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'AUTOMOBILE')")
def filter_flags_and_where(spark, d):
    return dump(spark, d).table("customer").scan(["c_custkey"], filters=["c_nationkey = 3", "c_acctbal > 0"], where="c_mktsegment = BUILDING or c_mktsegment = AUTOMOBILE")


def nullable_dump(spark, d) -> Dump:
    def make(part: str) -> None:
        rows = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 5000).alias("rich"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"))
        write_dump(part, {"flags": rows})

    return Dump(spark, dump_path(spark, d, "flags", make))


FLAGS = "(SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal > 5000 END AS rich, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer)"


@query(f"SELECT c_custkey, segment FROM {FLAGS} WHERE rich IS NOT TRUE AND segment IS NOT NULL")
def filter_bool_is(spark, d):
    from .plans.predicate import And

    return nullable_dump(spark, d).table("flags").scan(["c_custkey", "segment"], tree=And((is_truth("rich", True, negated=True), Term("segment", "is not null"))))


@query(f"SELECT c_custkey FROM {FLAGS} WHERE rich IS UNKNOWN OR segment IS NULL")
def filter_bool_unknown(spark, d):
    from .plans.predicate import Or

    return nullable_dump(spark, d).table("flags").scan(["c_custkey"], tree=Or((is_truth("rich", None), Term("segment", "is null"))))


@query(f"SELECT c_custkey FROM {FLAGS} WHERE segment IS NULL")
def filter_is_null(spark, d):
    return nullable_dump(spark, d).table("flags").scan(["c_custkey"], where="segment is null")


@query(f"SELECT c_custkey FROM {FLAGS} WHERE segment IS NOT NULL AND rich IS NOT NULL")
def filter_is_not_null(spark, d):
    return nullable_dump(spark, d).table("flags").scan(["c_custkey"], where="segment is not null and rich is not null")


same("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing' AND p_type NOT LIKE 'SM%'")
same("filter_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%'")
same("filter_regex", "SELECT p_partkey FROM part WHERE regexp_like(p_name, '^[a-r].*[gt]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-r].*[gt]$')")
same("filter_similar_to", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')")

# ---- pruning and statistics -------------------------------------------------------------------------------


def pruned_scan(spark, d, table: str, must_skip: bool, columns, **options) -> DataFrame:
    t = mapped(spark, d).table(table, group_bytes=GROUP_BYTES)
    out = t.scan(columns, use_statistics=True, **options)
    if must_skip and t.metrics["row_groups"] > 4 and not t.metrics["row_groups_pruned_statistics"]:
        raise AssertionError("no row group was skipped")
    return out


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def prune_range(spark, d):
    return pruned_scan(spark, d, "orders", True, ["o_orderkey", "o_totalprice"], where="o_orderkey >= 100 and o_orderkey < 200")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'none' OR o_orderkey = 7")
def prune_dictionary(spark, d):
    return pruned_scan(spark, d, "orders", True, ["o_orderkey"], where="o_orderstatus = none or o_orderkey = 7")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey > 50 OR o_orderpriority IS NULL)")
def prune_kleene(spark, d):
    return pruned_scan(spark, d, "orders", True, ["o_orderkey"], where="not (o_orderkey > 50 or o_orderpriority is null)")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def prune_topk(spark, d):
    return mapped(spark, d).table("orders", group_bytes=GROUP_BYTES).top("o_totalprice", 1, True, columns=["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 100000)")
def prune_semi_join(spark, d):
    """Keys that grow with the data: by their list while they are few, by their bounds beyond."""
    keys = read(spark, d, "lineitem").where("l_extendedprice > 100000").select("l_orderkey")
    return mapped(spark, d).table("orders", group_bytes=GROUP_BYTES).semi_join_prune("o_orderkey", keys, columns=["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def unpruned_range(spark, d):
    """prune_range without statistics: the base of their ratio."""
    return mapped(spark, d).table("orders").scan(["o_orderkey", "o_totalprice"], where="o_orderkey >= 100 and o_orderkey < 200")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def unpruned_topk(spark, d):
    """prune_topk without statistics: the base of their ratio."""
    return mapped(spark, d).table("orders").scan(["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high, CAST(sum(l_linenumber) AS BIGINT) AS total, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def stats_answers(spark, d):
    a = mapped(spark, d).table("lineitem", group_bytes=GROUP_BYTES).stats_aggregate(("count", None), ("min", "l_orderkey"), ("max", "l_orderkey"), ("sum", "l_linenumber"), ("count_distinct", "l_returnflag"))
    return spark.createDataFrame([(a["count"], a["min_l_orderkey"], a["max_l_orderkey"], a["sum_l_linenumber"], a["count_distinct_l_returnflag"])], "n long, low long, high long, total long, flags long")


@query("SELECT 'c_custkey' AS name, count(*) AS rows, count(*) - count(c_custkey) AS nulls, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), CAST(sum(c_nationkey) AS BIGINT) FROM customer")
def stats_summary(spark, d):
    found = mapped(spark, d).table("customer", group_bytes=GROUP_BYTES).summary().where("name IN ('c_custkey', 'c_nationkey')")
    return found.select("name", "rows", "nulls", F.col("total").cast("long").alias("total"))


@query(None)
def stats_row_groups(spark, d):
    """Every statistic of every row group of orders."""
    return dump(spark, d).table("orders", group_bytes=64 << 10).statistics()


@query("SELECT count(*) AS n, CAST(sum(length(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS key_bytes, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(sum(o_orderkey) AS BIGINT) AS total, true AS ordered FROM orders")
def stats_sorted_sizes(spark, d):
    """Order, bytes, bounds and sums of a sorted column, put together from its row groups."""
    groups = dump(spark, d).table("orders", group_bytes=GROUP_BYTES).statistics(["o_orderkey"])
    number = [F.col(c).cast("long") for c in ("low", "high")]
    return groups.agg(
        F.sum("rows").alias("n"), F.sum("value_bytes").alias("key_bytes"), F.min(number[0]).alias("low"), F.max(number[1]).alias("high"),
        F.sum("total").cast("long").alias("total"), F.every(F.col("order") == "ascending").alias("ordered"),
    )


@query("SELECT 'customer' AS \"table\", count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'region', count(*) FROM region")
def stats_counts(spark, d):
    """Row counts of whole tables from statistics alone."""
    found = dump(spark, d)
    rows = [(t, found.table(t).stats_aggregate(("count", None))) for t in ("customer", "region")]
    return spark.createDataFrame([(t, int(next(iter(a.values())))) for t, a in rows], "table string, n long")


@query("SELECT * FROM (VALUES ('region', 0, 'r_regionkey', 'integer', 'int'), ('region', 1, 'r_name', 'text', 'string')) AS t(\"table\", position, name, declared, spark_type)")
def info_columns(spark, d):
    return info.columns(dump(spark, d)).where("table = 'region'").select("table", "position", "name", "declared", "spark_type")


@query("SELECT * FROM (VALUES ('TABLE', CAST(8 AS BIGINT)), ('TABLE DATA', 8)) AS t(kind, n)")
def info_object_kinds(spark, d):
    return info.object_kinds(dump(spark, d)).select("kind", "n")


@query("SELECT * FROM (VALUES ('region', 2), ('nation', 3), ('customer', 5)) AS t(\"table\", n)")
def info_blocks(spark, d):
    found = info.blocks(dump(spark, d)).where("table IN ('region', 'nation', 'customer') AND start < data_start AND data_end < end")
    return found.select("table", F.size("columns").alias("n"))


# ---- table composition ----------------------------------------------------------------------------------


def family_dump(spark, d) -> Dump:
    """nation as a parent with two children, one of them with a column of its own and another order."""
    def make(part: str) -> None:
        rows = [tuple(r) for r in read(spark, d, "nation").orderBy("n_nationkey").collect()]
        with open(part, "w", newline="\n") as f:
            f.write(HEAD)
            f.write(create_table("public", "place", [("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer")]))
            f.write(create_table("public", "far", [("extra", "text")]).replace("\n);", "\n)\nINHERITS (public.place);"))
            f.write("CREATE TABLE public.near () INHERITS (public.place);\n\n")
            f.write("CREATE TABLE public.parted (k integer NOT NULL, v text) PARTITION BY LIST (k);\n\nCREATE TABLE public.parted_a (v text, k integer NOT NULL);\n\n")
            f.write("ALTER TABLE ONLY public.parted ATTACH PARTITION public.parted_a FOR VALUES IN (0, 1);\n\n")
            f.write(copy_block("public", "place", ["n_nationkey", "n_name", "n_regionkey"], [r for r in rows if r[0] % 3 == 0]))
            f.write(copy_block("public", "far", ["n_regionkey", "n_nationkey", "n_name", "extra"], [(r[2], r[0], r[1], "x") for r in rows if r[0] % 3 == 1]))
            f.write(copy_block("public", "near", ["n_nationkey", "n_name", "n_regionkey"], [r for r in rows if r[0] % 3 == 2]))
            f.write(copy_block("public", "parted_a", ["v", "k"], [(r[1], r[0] % 2) for r in rows]))

    return Dump(spark, dump_path(spark, d, "family", make))


@query("SELECT * FROM nation")
def table_descendants(spark, d):
    return family_dump(spark, d).table("place").scan()


@query("SELECT * FROM nation WHERE n_nationkey % 3 = 0")
def table_only(spark, d):
    return family_dump(spark, d).table("place", inheritance="only").scan()


@query("SELECT n_nationkey % 2 AS k, n_name AS v FROM nation")
def table_partitioned(spark, d):
    return family_dump(spark, d).table("parted").scan()


@query("SELECT a.n_name AS name, count(*) AS n FROM nation a CROSS JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) b GROUP BY a.n_name")
def table_registered_twice(spark, d):
    both = family_dump(spark, d)
    other = both.table("place", inheritance="only").scan().select(F.col("n_nationkey").alias("k"))
    return both.table("place").scan().crossJoin(other).groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


# ---- aggregation ------------------------------------------------------------------------------------------

same("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_avg", "SELECT l_linenumber, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_linenumber")
same("agg_distinct", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS total FROM lineitem")
same("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_returnflag")
same("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("agg_cube", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linenumber)")
same("agg_grouping_sets", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("agg_stddev_corr", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_samp(l_quantity, l_discount), 4) AS cv, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope FROM lineitem GROUP BY l_returnflag")
same("agg_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every, bool_or(o_totalprice > 400000) AS some, bit_and(o_custkey) AS ba, bit_or(o_custkey) AS bo, bit_xor(o_custkey) AS bx FROM orders GROUP BY o_orderstatus")
same("agg_string_array", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, sort_array(array_agg(n_nationkey)) AS numbers FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list_sort(array_agg(n_nationkey)) AS numbers FROM nation GROUP BY n_regionkey")
same("agg_median_percentile", "SELECT l_linenumber, round(median(l_quantity), 4) AS mid, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity), 4) AS p90 FROM lineitem GROUP BY l_linenumber")
same(
    "agg_ordered_values",
    "SELECT o_custkey, first_value(o_orderkey ORDER BY o_totalprice) AS cheap, last_value(o_orderkey ORDER BY o_totalprice) AS dear, nth_value(o_orderkey, 2 ORDER BY o_orderkey DESC) AS late FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS cheap, arg_max(o_orderkey, o_totalprice) AS dear, list_sort(list(o_orderkey), 'DESC')[2] AS late FROM orders GROUP BY o_custkey",
)
same("agg_first_last", "SELECT o_orderstatus, min_by(o_orderkey, o_orderkey) AS first_key, max_by(o_orderdate, o_orderkey) AS last_date FROM orders GROUP BY o_orderstatus")


@query("SELECT n_regionkey, CAST((sum(CAST(n_nationkey AS HUGEINT) * 4000000000000000000) + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS wrapped FROM nation GROUP BY n_regionkey")
def agg_wrapping_sum(spark, d):
    big = F.col("n_nationkey").cast("decimal(20,0)") * F.lit(4000000000000000000).cast("decimal(19,0)")
    return read(spark, d, "nation").groupBy("n_regionkey").agg(scalars.wrapping_sum(big).alias("wrapped"))


@query(None)
def agg_approximate(spark, d):
    """Approximate distinct counts and percentiles: within a tolerance, so without SQL."""
    rows = read(spark, d, "lineitem")
    return rows.agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.approx_percentile("l_quantity", [0.5, 0.9]).alias("quantiles"))


@query("SELECT true AS orders_near, true AS median_near")
def agg_approximate_error(spark, d):
    """Approximate aggregates beside the exact ones: a tenth is within their tolerance.

    The distinct count is made apart: beside it each key would get sketches of its own.
    """
    rows = read(spark, d, "lineitem")
    sketches = rows.agg(F.approx_count_distinct("l_orderkey", 0.03).alias("near"), F.approx_percentile("l_quantity", 0.5).alias("half"), F.median("l_quantity").alias("median"))
    both = sketches.join(rows.agg(F.count_distinct("l_orderkey").alias("exact")))  # one row each
    return both.select((F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * 0.1).alias("orders_near"), (F.abs(F.col("half") - F.col("median")) <= 1).alias("median_near"))


same("agg_select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
same("agg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# ---- joins ----------------------------------------------------------------------------------------------------

same("join_inner", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
same("join_two_keys", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.top")
same("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
same("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000")
same("join_full", "SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey")
same("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
same("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
same("join_mark", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big FROM customer")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
same("join_using", "SELECT n_regionkey, count(*) AS n FROM nation JOIN (SELECT r_regionkey AS n_regionkey FROM region) r USING (n_regionkey) GROUP BY n_regionkey")
same("join_natural", "SELECT n_regionkey, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
same("join_null_safe", "SELECT a.n_nationkey FROM nation a JOIN (SELECT nullif(n_regionkey, 2) AS k FROM nation) b ON nullif(a.n_regionkey, 2) IS NOT DISTINCT FROM b.k")
same("join_lateral", "SELECT r_name, top_name FROM region, LATERAL (SELECT max(n_name) AS top_name FROM nation WHERE n_regionkey = r_regionkey) t")


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_sort_merge(spark, d):
    return read(spark, d, "orders").hint("merge").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark, d):
    region = read(spark, d, "region")  # five rows, whatever the scale
    return read(spark, d, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, band FROM customer JOIN (SELECT p_size AS band, p_size * 100.0 AS low, p_size * 100.0 + 50.0 AS high FROM (SELECT DISTINCT p_size FROM part)) ON c_acctbal >= low AND c_acctbal < high")
def join_range(spark, d):
    bands = read(spark, d, "part").select(F.col("p_size").alias("band")).distinct()
    bands = bands.select("band", (F.col("band") * 100.0).alias("low"), (F.col("band") * 100.0 + 50.0).alias("high"))
    return relational.range_join(read(spark, d, "customer"), bands, "c_acctbal", "low", "high", 100.0).select("c_custkey", "band")


@query("SELECT e.event_id, p.bought FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS bought FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(spark, d):
    """Each event with its user's latest purchase not after it."""
    events = read(spark, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("bought"))
    return relational.as_of_join(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["bought"]).select("event_id", "bought")


same("join_theta_only", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def udtf_parquet_metadata(spark, d):
    """Row counts by the footers of files, beside a lateral use of a table function."""
    tables.register(spark)
    path = file_folder(d, spark, "footers-orders")
    read(spark, d, "orders").select("o_custkey").write.mode("overwrite").parquet(path)
    rows = spark.sql(f"SELECT sum(rows) AS n FROM parquet_metadata('{path}') WHERE column = 'o_custkey'")
    return rows.join(spark.read.parquet(path).agg(F.count_distinct("o_custkey").alias("customers")))  # one row each


@query("SELECT r_regionkey, CAST(value AS BIGINT) AS value FROM region, LATERAL (SELECT unnest(generate_series(1, r_regionkey)) AS value)")
def udtf_generate_series(spark, d):
    tables.register(spark)
    read(spark, d, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, g.value FROM region, LATERAL generate_series(1, r_regionkey, 1) AS g")


# ---- windows, order, sets, subqueries ---------------------------------------------------------------------------

same("window_rank", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS r, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS dr, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn, round(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name), 6) AS pr, round(cume_dist() OVER (PARTITION BY n_regionkey ORDER BY n_name), 6) AS cd FROM nation")
same("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS quarter FROM customer")
same("window_lag_lead", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
same("window_frame_rows", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
same("window_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
same("window_aggregate", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS best FROM customer")
same("window_ignore_nulls", "SELECT c_custkey, last_value(nullif(c_nationkey, 3)) IGNORE NULLS OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM customer", "SELECT c_custkey, last_value(nullif(c_nationkey, 3) IGNORE NULLS) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM customer")
same("window_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM customer")
def window_groups(spark, d):
    return relational.over_groups(read(spark, d, "customer"), F.count(F.lit(1)), ["c_mktsegment"], ["c_nationkey"], 1, 0, "n").select("c_custkey", "n")


@query("SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 3) ASC NULLS LAST, c_custkey) AS place FROM customer")
def sort_nulls_last(spark, d):
    """The database's order, NULLs as the largest value, over ranges and not in one task."""
    return sorted_places(spark, d, False)


@query("SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey) AS place FROM customer")
def sort_nulls_desc(spark, d):
    return sorted_places(spark, d, True)


def sorted_places(spark, d, descending: bool) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    first = F.col("k").desc_nulls_first() if descending else F.col("k").asc_nulls_last()
    return numbered(spark, d, rows, [first, F.col("c_custkey").asc()], "place").select("c_custkey", "place")


same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
same("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
same("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
same("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
same("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
same("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
same("cte", "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_nationkey, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE top > 200000 GROUP BY c_nationkey")
same("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
same("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same("subq_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
same("subq_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
same("subq_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier)")
def subq_all(spark, d):
    return relational.compare_any(read(spark, d, "customer"), "c_acctbal", ">", read(spark, d, "supplier").select("s_acctbal"), every=True).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier)")
def subq_any(spark, d):
    return relational.compare_any(read(spark, d, "customer"), "c_acctbal", "<", read(spark, d, "supplier").select("s_acctbal")).select("c_custkey")


same("values_table", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
same("unnest_array", "SELECT e FROM unnest(array(1, 2, 3)) AS t(e)", "SELECT unnest([1, 2, 3]) AS e")
same("generate_series", "SELECT v FROM generate_series(1, 20, 3) AS t(v)", "SELECT CAST(v AS INT) AS v FROM generate_series(1, 20, 3) AS t(v)")
same(
    "unpivot",
    "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part) UNPIVOT (amount FOR what IN (size, price))",
    "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', CAST(p_retailprice AS DOUBLE) FROM part",
)
same("pivot", "SELECT * FROM (SELECT l_returnflag, l_linenumber FROM lineitem) PIVOT (count(*) FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))", "SELECT l_linenumber, nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS a, nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS n, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY l_linenumber")

# ---- scalar functions -----------------------------------------------------------------------------------------------

same(
    "fn_string",
    "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, initcap(lower(n_name)) AS cap, length(n_name) AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', 'x') AS rep, reverse(n_name) AS rev, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, split_part(n_name, ' ', 1) AS part, translate(n_name, 'AE', 'ae') AS tr, concat_ws('-', n_name, 'x') AS cw, left(n_name, 2) AS le, right(n_name, 2) AS ri, repeat('ab', 2) AS rpt, ascii(n_name) AS a, instr(n_name, 'A') AS pos, startswith(n_name, 'A') AS st, levenshtein(n_name, 'CHINA') AS lev FROM nation",
    "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap, length(n_name) AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', 'x') AS rep, reverse(n_name) AS rev, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, split_part(n_name, ' ', 1) AS part, translate(n_name, 'AE', 'ae') AS tr, concat_ws('-', n_name, 'x') AS cw, left(n_name, 2) AS le, right(n_name, 2) AS ri, repeat('ab', 2) AS rpt, ascii(n_name) AS a, instr(n_name, 'A') AS pos, starts_with(n_name, 'A') AS st, levenshtein(n_name, 'CHINA') AS lev FROM nation",
)
same("fn_regexp", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS rep, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_count(p_name, '[aeiou]') AS vowels FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS rep, regexp_extract(p_brand, '([0-9]+)', 1) AS num, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels FROM part")
same("fn_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('month', o_orderdate) AS INT) AS mo, CAST(o_orderdate AS DATE) AS day, make_date(2020, 2, 29) AS leap FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('month', o_orderdate) AS INT) AS mo, CAST(o_orderdate AS DATE) AS day, make_date(2020, 2, 29) AS leap FROM orders")


@query("SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin, strftime(ts, '%Y/%m/%d %H') AS shown, epoch_us(ts) // 1000000 AS unix FROM events")
def fn_date_bin(spark, d):
    rows = read(spark, d, "events")
    return rows.select("event_id", scalars.date_bin("15 minutes", F.col("ts")).alias("bin"), scalars.to_char(F.col("ts"), "%Y/%m/%d %H").alias("shown"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix"))


same("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS l, round(power(c_nationkey, 2), 2) AS p, sign(c_acctbal) AS s, c_custkey % 7 AS m, round(cbrt(c_nationkey), 6) AS cb, round(degrees(c_nationkey), 6) AS dg, round(atan2(c_nationkey, 2), 6) AS at, factorial(5) AS f FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS l, round(power(c_nationkey, 2), 2) AS p, CAST(sign(c_acctbal) AS DOUBLE) AS s, c_custkey % 7 AS m, round(cbrt(c_nationkey), 6) AS cb, round(degrees(c_nationkey), 6) AS dg, round(atan2(c_nationkey, 2), 6) AS at, CAST(factorial(5) AS BIGINT) AS f FROM customer")


@query("SELECT c_custkey, CAST(gcd(c_custkey, 36) AS BIGINT) AS g, CAST(lcm(c_custkey, 12) AS BIGINT) AS l, c_custkey // 7 AS q, c_nationkey = 0 AS z FROM customer")
def fn_integer(spark, d):
    c = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", scalars.gcd(c, F.lit(36)).alias("g"), scalars.lcm(c, F.lit(12)).alias("l"), F.expr("c_custkey div 7").alias("q"), scalars.iszero(F.col("c_nationkey")).alias("z"))


same("fn_conditional", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS co, greatest(c_nationkey, 5) AS g, least(c_nationkey, 5) AS l, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS band FROM customer")
same(
    "fn_array",
    "SELECT array_append(array(1, 2), 3) AS ap, array_position(array(5, 6, 7), 6) AS po, array_contains(array(1, 2), 2) AS co, array_distinct(array(1, 1, 2)) AS di, array_union(array(1, 2), array(2, 3)) AS un, array_intersect(array(1, 2), array(2, 3)) AS it, array_except(array(1, 2), array(2)) AS ex, array_remove(array(1, 2, 1), 1) AS re, slice(array(1, 2, 3, 4), 2, 2) AS sl, array_sort(array(3, 1, 2)) AS so, array_join(array('a', 'b'), '-') AS jo, flatten(array(array(1), array(2, 3))) AS fl, size(array(1, 2, 3)) AS si, array_repeat(7, 2) AS rp, reverse(array(1, 2, 3)) AS rv",
    "SELECT [1, 2, 3] AS ap, CAST(2 AS BIGINT) AS po, true AS co, [1, 2] AS di, [1, 2, 3] AS un, [2] AS it, [1] AS ex, [2] AS re, [2, 3] AS sl, [1, 2, 3] AS so, 'a-b' AS jo, [1, 2, 3] AS fl, 3 AS si, [7, 7] AS rp, [3, 2, 1] AS rv",
)
same("fn_struct_map", "SELECT r_regionkey, struct(r_regionkey, r_name).r_name AS name, map('k', r_name)['k'] AS v, map_keys(map('a', 1, 'b', 2)) AS ks, map_values(map('a', 1, 'b', 2)) AS vs FROM region", "SELECT r_regionkey, r_name AS name, r_name AS v, ['a', 'b'] AS ks, [1, 2] AS vs FROM region")
same("fn_json", "SELECT event_id, get_json_object(props, '$.' || 'k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
same("fn_hash_encode", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, base64(CAST(n_name AS BINARY)) AS b, lower(hex(n_name)) AS h, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS back FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, to_base64(n_name::BLOB) AS b, lower(hex(n_name)) AS h, n_name AS back FROM nation")
same("fn_cast", "SELECT p_partkey, CAST(p_size AS STRING) AS s, try_cast(p_name AS INT) AS t, CAST(p_retailprice AS DECIMAL(12,1)) = p_retailprice AS whole FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, try_cast(p_name AS INT) AS t, CAST(p_retailprice AS DECIMAL(12,1)) = p_retailprice AS whole FROM part")

# ---- windows over time, sinks ---------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_tumbling(spark, d):
    return windows.windowed(read(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")])


@query("WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '30 minutes' AS window_start FROM events, (VALUES (0), (1)) AS s(k)) SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, count(*) AS n FROM w GROUP BY ALL")
def time_sliding(spark, d):
    return windows.windowed(read(spark, d, "events"), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], slide="30 minutes")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL '1 hour' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, no")
def time_session(spark, d):
    return windows.sessions(read(spark, d, "events"), "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")])


@query("SELECT * FROM supplier")
def sink_parquet(spark, d):
    path = os.path.join(shared_folder(spark), "out-supplier-" + hashlib.sha256(d.encode()).hexdigest()[:12])
    dump(spark, d).table("supplier").scan().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query("SELECT CAST(s_suppkey AS VARCHAR) || chr(9) || s_name || chr(9) || CAST(s_nationkey AS VARCHAR) AS line FROM supplier")
def sink_text(spark, d):
    from .operators.render import rendered

    return rendered(dump(spark, d).table("supplier"), ["s_suppkey", "s_name", "s_nationkey"])


_found, _sql = typequeries.registered(dump_path)
QUERIES |= _found
ORACLES |= _sql
