"""Connected components of an undirected edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.scratch import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of comparable ids to ``(id, component_id)``, the smallest id reachable.

    Only ids with an edge to another id come back. Loops and repeated edges change nothing; no edges
    give no rows. Every round aggregates minima (combined before the shuffle) and joins on the id, so
    a hub of any degree is dealt out by skew handling; rounds grow with the logarithm of the size.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour of a goes to the least of a's neighbours
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # settled: all edges lead to roots, one from each other id
        several = now.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("a")
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").select("a").union(several).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)
