"""Connected components of an edge table, by alternating large and small stars.

Edges never leave the cluster.  A round costs two pairs of shuffles on vertex ids and
the number of rounds grows with the logarithm of a component's diameter; callers hand
in local spanning stars, so that two to four rounds are usual.  Lineage is cut at the
end of every round in the shared checkpoint folder, so that a lost executor costs the
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # cut, so that the join has an exchange of its own on either side and can split a hot centre
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of comparable ids -> (node, component), component the least id reachable.

    Nodes without an edge, and the least node of each component, have no row.
    Loops and repeated edges are harmless; an empty table gives an empty table.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state, mark = cut(ordered), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
        state = cut(_small_star(cut(_large_star(state))))
