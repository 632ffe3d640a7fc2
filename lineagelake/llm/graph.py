"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is one
pre-aggregated minimum per vertex and one join, so a vertex with very many edges neither
meets in one task (partial aggregation) nor in one join partition (AQE splits its edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.session import own_exchange, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v): adds m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(own_exchange(least, "u"), "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down).select("u", "v", "m")
    star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return star.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u long, v long), any direction, loops and repeats allowed.

    Returns (node, root): root is the smallest node reachable. Nodes without an edge
    to another node have no row. No edges: an empty frame.
    """
    now = stored(edges.where("u <> v").select("u", "v").distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now)))
        mark, last = _mark(now), mark
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
