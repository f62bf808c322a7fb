"""Connected components of an edge table, by alternating large and small stars; nothing is collected but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, materialise


def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no node hangs on two others, and none that hangs on one has others."""
    child = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parent = edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    roles = child.unionByName(parent).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest reachable node.

    Each round points every node's larger neighbours at its smallest neighbour, then every node and its smaller
    neighbours at the smallest one. The number of edges does not grow; it ends when only stars are left.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = materialise(edges.where("a <> b").select(least.alias("u"), most.alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if settled(now):
            break
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        base = large.groupBy("v").agg(F.min("u").alias("m"))
        pointed = large.join(base, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        before, now = now, materialise(pointed.unionByName(base.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
