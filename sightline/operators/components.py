"""Connected components of an edge table, by alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Every round is a pair of
aggregations and joins; nothing but one count per round reaches the driver, and each round is written to the shared
folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.tables import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over rows (u, v) with u <> v.

    Large: every neighbour greater than u is joined to the least of u and its neighbours. Small: every neighbour
    at most u, and u itself, is joined to the least of them.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of `edges` (u, v), component being the least node reachable.

    Nulls and self-edges carry no link and are left out; a node with no other edge does not appear, so callers use
    coalesce(component, node). An empty edge table gives an empty result. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = scratch.keep(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seal = None
    for _ in range(max_rounds):
        new = scratch.keep(_star(_star(now, True), False))
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(mark) == seal:
            break
        seal = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
