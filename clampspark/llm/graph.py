"""Connected components of an undirected edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clampspark.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(node, root)`` for every node that is not its own root.

    The root is the smallest id reachable. Each round hooks neighbours to the smallest one, so the number of
    rounds grows with the logarithm of the component size; a hub's edges are joined, never gathered in a list.
    Every round is written to the shared folder, which cuts the lineage. An empty edge list gives no rows.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    seen = None
    while True:
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialise(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
        if tuple(state) == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = tuple(state)
