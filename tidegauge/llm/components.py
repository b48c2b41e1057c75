"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one grouped minimum and one equi-join, so a hub with a third of all edges is
pre-aggregated before its shuffle and split by adaptive skew handling in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`: its first two columns, of one orderable type.

    component is the smallest node reachable. Edges with a null end and self-loops are ignored;
    repeated edges count once. Nodes without an edge to another node are not returned.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("ok"))
    now = written(pairs.where("ok").select("u", "v").distinct())
    for _ in range(max_rounds):
        stars = written(_small_star(_large_star(now)))
        discard(now)
        now = stars
        if _settled(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


def _settled(e: DataFrame) -> bool:
    """Whether edges are stars: nodes that are tied to one are tied once, and none to them. Another round would change nothing then."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("tied")).union(e.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.max("tied").alias("tied"), F.count("*").alias("n"))
    return ends.agg(F.count_if((F.col("tied") == 1) & (F.col("n") > 1))).first()[0] == 0


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours. Edges (u, v) have u > v, here and after."""
    least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    tied = e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    return tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
