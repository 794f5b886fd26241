"""Reproducible sampling and splitting (inventory E1-E5).

Every row gets a 52-bit hash of (seed, key) from ``md5`` (a function both
Spark and SQL engines share), so a sample or split is the same on any
cluster size and any partitioning, and needs no shuffle to draw. Exact sizes
("n rows", "15 % of each class") come from the distributed rank selection
in ``quantiles``: the k-th smallest hash per class is found, then rows are
kept with one filter. Nothing is ordered globally and nothing passes through
one task or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored
from .quantiles import grouped_quantiles, kth_smallest, select_ranks, value_ranges

TWO_52 = float(2 ** 52)
#: Rows of per-class cut-offs that are broadcast at most.
MAX_BROADCAST_CLASSES = 100_000


def row_hash(key: str | Column, seed: int = 42) -> Column:
    """52-bit integer hash of (seed, key), exact in a double."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")


def uniform(key: str | Column, seed: int = 42) -> Column:
    """Deterministic uniform in [0, 1) per key."""
    return row_hash(key, seed) / F.lit(TWO_52)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows (per group with ``by``), all rows when fewer:
    the rows whose hash is at or below the n-th smallest hash."""
    by = list(by)
    h = df.withColumn("_h", row_hash(key, seed))
    cut = kth_smallest(h, "_h", F.least(F.col("_n"), F.lit(n)) - 1, by, "_cut")
    if by:
        return h.join(cut, by).where(F.col("_h") <= F.col("_cut")).drop("_h", "_cut")
    return h.where(F.col("_h") <= cut.scalar()).drop("_h")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.15, val_of_rest: float = 0.1765,
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` in {train, val, test}. Per class, the
    ``ceil(test * n)`` rows with the smallest hash are test; of the rest,
    ``ceil(val_of_rest * rest)`` are validation (the reference's two
    successive stratified splits)."""
    h = df.withColumn("_h", row_hash(key, seed))
    k_test = F.ceil(F.col("_n") * test)
    k_val = F.ceil((F.col("_n") - F.ceil(F.col("_n") * test)) * val_of_rest)
    # both cut-offs of every class in one selection
    values = stored(h.select(label, F.col("_h").cast("double").alias("_v")), "split-hashes")
    stats = value_ranges(values, [label])
    wanted = stats.select("*", F.explode(F.array(F.struct(F.lit("_c1").alias("_name"), (k_test - 1).cast("long").alias("_r")),
                                                 F.struct(F.lit("_c2").alias("_name"), (k_test + k_val - 1).cast("long").alias("_r")))).alias("_w"))
    wanted = wanted.select(label, "_w._name", "_w._r").where(F.col("_r") >= 0)
    solved = select_ranks(values, [label], wanted.select(label, "_r").distinct(), stats)
    cuts = (wanted.select(label, "_name", "_r").join(solved, [label, "_r"]).groupBy(label)
            .agg(F.max(F.when(F.col("_name") == "_c1", F.col("_val"))).alias("_c1"), F.max(F.when(F.col("_name") == "_c2", F.col("_val"))).alias("_c2")))
    cuts = cut_lineage(stats.select(label).join(cuts, label, "left"))
    # a row a class; a label of many values is joined by shuffle instead
    j = h.join(F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST_CLASSES else cuts, label)
    split = (F.when(F.col("_c1").isNotNull() & (F.col("_h") <= F.col("_c1")), "test")
             .when(F.col("_c2").isNotNull() & (F.col("_h") <= F.col("_c2")), "val")
             .otherwise("train"))
    return j.withColumn("split", split).drop("_h", "_c1", "_c2")


def hashed_split(df: DataFrame, key: str, test: float = 0.15, val_of_rest: float = 0.1765,
                 seed: int = 42) -> DataFrame:
    """E2 without exact sizes: a per-row hash threshold (no aggregation at
    all; sizes are binomial around the targets). The cheapest form at scale."""
    u = uniform(key, seed)
    cut2 = test + (1 - test) * val_of_rest
    return df.withColumn("split", F.when(u < test, "test").when(u < cut2, "val").otherwise("train"))


def stratified_sample(df: DataFrame, label: str, key: str, max_rows: int | None,
                      seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows keeping class shares: per class
    ``floor(max_rows * n_c / n)`` rows plus one for the classes with the
    largest remainders (ties by label) until ``max_rows`` is reached; a no-op
    when the frame is small enough."""
    if max_rows is None:
        return df
    h = df.withColumn("_h", row_hash(key, seed))
    sizes = h.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w_all = Window.partitionBy()  # over the per-class table only
    exact = F.col("_nc") * F.lit(max_rows) / F.col("_N")
    alloc = (sizes.withColumn("_N", F.sum("_nc").over(w_all))
             .withColumn("_base", F.floor(exact))
             .withColumn("_rem", exact - F.col("_base"))
             .withColumn("_short", F.lit(max_rows) - F.sum("_base").over(w_all))
             .withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("_rem"), label)))
             .withColumn("_k", F.when(F.col("_N") <= max_rows, F.col("_nc"))
                         .otherwise(F.col("_base") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)))
             .select(label, "_k"))
    alloc = cut_lineage(alloc)
    small = alloc.count() <= MAX_BROADCAST_CLASSES
    hk = h.join(F.broadcast(alloc) if small else alloc, label)
    cut = kth_smallest_by_alloc(hk, label)
    return hk.join(F.broadcast(cut) if small else cut, label).where(F.col("_h") <= F.col("_cut")).drop("_h", "_k", "_cut")


def kth_smallest_by_alloc(hk: DataFrame, label: str) -> DataFrame:
    """Per class, the hash at rank ``_k - 1`` (``_k`` carried on each row)."""
    values = stored(hk.select(label, F.col("_h").cast("double").alias("_v"), "_k"), "sample-hashes")
    ranks = values.groupBy(label).agg(F.first("_k").alias("_k")).where(F.col("_k") > 0).select(label, (F.col("_k") - 1).cast("long").alias("_r"))
    solved = select_ranks(values.select(label, "_v"), [label], ranks)
    return solved.select(label, F.col("_val").alias("_cut"))


def temporal_split(df: DataFrame, step: str = "step", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Cut-offs at the ``train`` and ``train + val`` quantiles of
    ``step`` (linear rule); ``<=`` first cut is train, ``>`` second is test."""
    q = grouped_quantiles(df, {"_c1": (step, train), "_c2": (step, train + val)})
    c1 = q.select("_c1").scalar()
    c2 = q.select("_c2").scalar()
    s = F.col(step)
    return df.withColumn("split", F.when(s <= c1, "train").when(s <= c2, "val").otherwise("test"))


def keep_positives_sample(df: DataFrame, label: str, key: str, n_negatives: int, seed: int = 42) -> DataFrame:
    """E5: every positive row plus ``n_negatives`` hash-sampled negatives,
    concatenated."""
    pos = df.where(F.col(label).cast("int") == 1)
    neg = sample_n(df.where(F.col(label).cast("int") != 1), n_negatives, key, seed)
    return pos.unionByName(neg)
