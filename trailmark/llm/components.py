"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges ``a``, ``b``.

    Each round is a few aggregates and joins over the edges; every node's edges shrink to one star, in a number of
    rounds that grows with the logarithm of the longest path. Nodes may have any ordered type. Loops, repeated
    edges and empty tables are fine.
    """
    stars = save(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        stars = save(small.where("a <> b").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
