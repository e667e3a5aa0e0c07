"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes of values of a decision table (ids or keys) that may be broadcast: about 64 MB
#: as a hashed relation.  Larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that a Python worker gets at a time: beside the JVM's heap, each task holds a few such batches.
BATCH_BYTES = 4 << 20

#: The six ASCII white-space characters of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(text, BLANKS, "")


def shared_folder(spark: SparkSession, fallback: str) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local one only if there is one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=fallback)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the cluster's shared checkpoint folder and read back.

    The folder is the one that ``spark.checkpoint.dir`` names; a folder of our own
    is set only where a session has none (tests on one machine).
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "quarry-ckpt-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: readers of a few columns read those only.  See ``forget``."""
    path = f"{shared_folder(df.sparkSession, 'quarry-tables-')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes, so that long texts don't add up to large ones.

    Batches are made when the plan runs, by the session's setting: one that is set already holds.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values of no fixed width, nested ones as JSON."""
    parts = [F.lit(0)]
    for field in df.schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
    return sum(parts[1:], parts[0])


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the (already cut) table has at most ``limit`` rows, and BROADCAST_BYTES in columns of no fixed width."""
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(value_bytes(df))).first()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def signature(id_col: str, text_col: str) -> list[Column]:
    """__i, __a, __b: what tells rows apart that have another id or another text (128 bits of it)."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("__i"), F.xxhash64(text).alias("__a"), F.xxhash64(text, F.lit(1)).alias("__b")]


SIGNATURE = ("__i", "__a", "__b")


def keep_one(docs: DataFrame, marked: DataFrame, group: str, first: list[Column], id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group.

    ``marked`` (already cut) has the signature of rows of ``docs``, their ``group`` and what ``first`` orders
    by; rows of ``docs`` that it lacks stay.  The first of a group stays: by ``first``, then the least id, null ids last, then
    the hash of the text.  Rows that repeat an id and a text are one row to this choice, and one of them
    stays if theirs does.  Rows of other texts never go for sharing an id.

    What goes is known by thin rows, (id, 128 bits of the text): broadcast if they are few, else texts
    meet them by a shuffle.
    """
    order = F.struct(*first, F.col("__i").isNull().alias("none"), *SIGNATURE).alias("order")
    rows = cut(marked.select(group, order).groupBy(group, "order").agg(F.count(F.lit(1)).alias("n")))
    # cut, so that the join has an exchange of its own on either side and can split a hot group
    best = cut(rows.groupBy(group).agg(F.min("order").alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1).withColumnRenamed(group, "__g"))
    met = rows.join(best, F.col(group) == F.col("__g")).select("n", "order", F.col("order").eqNullSafe(F.col("best")).alias("stays"))
    met = cut(met.where("not stays or n > 1").select("stays", *[F.col(f"order.{c}").alias(c) for c in SIGNATURE]))
    losers, repeated = met.where("not stays").select(*SIGNATURE), met.where("stays").select(*SIGNATURE)
    keyed = docs.select("*", *[c.alias(f"_{n}") for c, n in zip(signature(id_col, text_col), SIGNATURE)])

    def same(right: DataFrame) -> Column:
        met = [keyed[f"_{c}"].eqNullSafe(right[c]) for c in SIGNATURE]
        return met[0] & met[1] & met[2]

    def side(right: DataFrame) -> DataFrame:
        return F.broadcast(right) if bounded(right) else right

    left = side(losers)
    kept = keyed.join(left, same(left), "left_anti")
    if repeated.isEmpty():
        return kept.drop(*[f"_{c}" for c in SIGNATURE])
    again = side(repeated)
    several = keyed.join(again, same(again), "left_semi").dropDuplicates([f"_{c}" for c in SIGNATURE])
    single = kept.join(again, same(again), "left_anti")
    return single.union(several).drop(*[f"_{c}" for c in SIGNATURE])


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)
