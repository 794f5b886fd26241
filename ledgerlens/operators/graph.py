"""Connected components of a distributed edge list by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two nodes; root is the
    component's smallest node.

    A round links each node's larger neighbours to its smallest one, then its
    smaller ones; the number of rounds grows with the logarithm of a
    component's size, not with its length. Each round is a written table."""
    pairs = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = None
    while True:
        around = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # hi: a node, lo: its neighbour
        low = around.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("low"))
        up = (around.where("lo > hi").join(low, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).distinct())
        low = up.groupBy("hi").agg(F.min("lo").alias("low"))
        down = up.join(low, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        pairs = stored(down.unionByName(low.select("hi", F.col("low").alias("lo"))).distinct(), "edges")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
