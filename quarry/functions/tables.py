"""Table functions for SQL: parquet_metadata and generate_series."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="row_group int, rows long, column string, type string, compressed long, uncompressed long, low string, high string, nulls long")
class ParquetMetadata:
    """Row groups and column chunks of a Parquet file or folder that the executors can open."""

    def eval(self, path: str):
        import glob
        import os

        import pyarrow.parquet as pq

        for file in sorted(glob.glob(os.path.join(path, "*.parquet"))) if os.path.isdir(path) else [path]:
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for i in range(group.num_columns):
                    c = group.column(i)
                    s = c.statistics if c.is_stats_set else None
                    bounds = (str(s.min), str(s.max)) if s and s.has_min_max else (None, None)
                    yield g, group.num_rows, c.path_in_schema, c.physical_type, c.total_compressed_size, c.total_uncompressed_size, *bounds, s.null_count if s else None


@udtf(returnType="value long")
class GenerateSeries:
    """Whole numbers from start to stop, both included; for long series spark.range is the distributed way."""

    def eval(self, start: int, stop: int, step: int = 1):
        if step == 0:
            raise ValueError("a step of zero")
        yield from ((x,) for x in range(start, stop + (1 if step > 0 else -1), step))


def register(spark: SparkSession) -> None:
    spark.udtf.register("parquet_metadata", ParquetMetadata)
    spark.udtf.register("generate_series", GenerateSeries)
