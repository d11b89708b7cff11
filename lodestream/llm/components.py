"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two shuffles of the edges; the number of steps grows with the logarithm of the longest path.
Every step is written to the shared folder, so that lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): every node u of an edge that is not the least of its component, and the least, v.

    edges: columns u, v of one orderable type, in either order, self-loops and repeats allowed.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = common.stored(edges, name)
    state = _state(edges)
    while True:
        last, edges = edges, common.stored(_small_star(_large_star(edges)), name)
        state, before = _state(edges), state
        common.discard(last)
        if state == before:
            return edges
