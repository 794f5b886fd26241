"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the
    smallest node of its component.

    Alternating large-star and small-star rounds: each replaces the edges by
    ones to a node's smallest neighbour and keeps the components, until only
    stars are left. Every round is a written table, so a lost executor costs
    one round at most. The driver sees two sums a round."""
    x = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    x = materialize(x, "edges")
    before = None
    while True:
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        both = x.select("u", "v").union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        x = materialize(small, "edges")
        now = x.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return x.select(F.col("u").alias("node"), F.col("v").alias("root")).union(x.select("v", "v").distinct())
