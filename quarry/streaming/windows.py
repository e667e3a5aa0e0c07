"""Windows over timestamped rows, for bounded tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(df: DataFrame, at: str, late: str | None) -> DataFrame:
    """With a watermark, which wants instants: timestamps without zone are taken in the session's."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if late else df


def windowed(df: DataFrame, at: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows; ``late``: the watermark of a stream."""
    rows = marked(df, at, late)
    out = rows.groupBy(F.window(at, size, slide) if slide else F.window(at, size), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Windows that end when a key has been quiet for ``gap``."""
    rows = marked(df, at, late)
    out = rows.groupBy(F.session_window(at, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def event_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in a window, of a stream of the events table."""
    return windowed(stream, "ts", size, ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], late=late)
