"""Connected components of an edge table, by alternating large-star and small-star steps.

Rounds end when the edges are stars, which one aggregation by node tells. Each step is a shuffle of the edges; between steps the edges are written to the shared folder. The least neighbour
of a centre of many edges reaches them by a broadcast of such centres, of which there are few (``join_hot``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, join_hot


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
    return join_hot(both.filter("b > a"), least, "a", "c", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    moved = join_hot(down, least, "a", "c", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars already, each with its least node as its centre: nodes are either below one centre or centres."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("centre").alias("centre"))
    return not nodes.agg(F.max(F.col("below") + F.col("centre")).alias("most")).filter("most > 1").count()


def connected_components(edges: DataFrame, ws: Workspace, most: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node reachable."""
    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            break
        total = now.count()
        now = ws.save(_small_star(_large_star(now, total), total), "stars")
        # shuffles and broadcasts of a round go when the driver collects its garbage
        ws.spark.sparkContext._jvm.System.gc()
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
