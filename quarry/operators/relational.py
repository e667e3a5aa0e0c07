"""Relational forms that Spark's SQL lacks or orders otherwise, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on window functions holds."""
    return df.withColumn("__q", condition).where("__q").drop("__q")


def over_groups(df: DataFrame, aggregate: Column, partition: list[str], order: list[str], before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers are numbered, then framed by RANGE over their numbers."""
    numbered = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*map(asc, order))))
    w = Window.partitionBy(*partition).orderBy("__g").rangeBetween(-before, after)
    return numbered.withColumn(name, aggregate.over(w)).drop("__g")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``left`` whose point lies in [low, high) of a row of ``right``: equi-join on buckets of a width, then the exact test.

    An interval goes to each bucket that it meets, so that no pair of rows is compared but within a bucket.
    """
    a = left.withColumn("__b", F.floor(F.col(point) / width))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "__b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, payload: list[str]) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` not after it: one union, one window, no pairs."""
    a = left.withColumns({"__t": F.col(at), "__side": F.lit(1), **{f"__{p}": F.lit(None).cast(right.schema[p].dataType) for p in payload}})
    b = right.select(*by, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), *(F.col(p).alias(f"__{p}") for p in payload))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{p}").alias(p) for p in payload))), ignorenulls=True).over(w)
    found = both.withColumn("__hit", last).where("__side = 1")
    return found.select(*left.columns, *(F.col("__hit")[p].alias(p) for p in payload))


def compare_any(df: DataFrame, column: str, op: str, other: DataFrame, every: bool = False) -> DataFrame:
    """column op ANY (ALL) of the one column of ``other``, by its least or largest value; true rows are kept.

    A NULL in ``other`` makes ALL unknown unless false; an empty ``other`` makes ALL true and ANY false.
    """
    name = other.columns[0]
    want_max = (op in ("<", "<=")) != every
    edge = other.agg((F.max if want_max else F.min)(name).alias("__e"), F.count(F.lit(1)).alias("__all"), F.count(name).alias("__known"))
    test = {"<": F.col(column) < F.col("__e"), "<=": F.col(column) <= F.col("__e"), ">": F.col(column) > F.col("__e"), ">=": F.col(column) >= F.col("__e")}[op]
    kept = ((F.col("__all") == 0) | (test & (F.col("__all") == F.col("__known")))) if every else test
    return df.crossJoin(F.broadcast(edge)).where(kept).drop("__e", "__all", "__known")  # the one aggregate row


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Whole numbers, both ends included."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def unnest(df: DataFrame, column: str, name: str = "value", outer: bool = False) -> DataFrame:
    return df.withColumn(name, (F.explode_outer if outer else F.explode)(column))


def numbered(df: DataFrame, by: list, name: str, path: str) -> DataFrame:
    """``df`` with the place of each row in the total order ``by``, from 1, and no task that has all rows.

    Rows are dealt by ranges, sorted within and written to ``path`` with their place in the range, so that a lost task
    finds the same ranges again; the ranges' sizes, one number a task, give the rest.
    """
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("__part", before.alias("__ahead"))
    place = F.col("__ahead") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(ahead), part == F.col("__part")).withColumn(name, place.cast("long")).drop("__at", "__part", "__ahead")
