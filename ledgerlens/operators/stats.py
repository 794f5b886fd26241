"""Aggregates, ordering, reshaping and statistics (inventory D1-D26).

All are grouped aggregates with map-side partial aggregation; medians and
quartiles go through the distributed exact selection in ``quantiles``.
Sorting happens only on the small aggregated results or as a bounded top-k
(``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition
top-k, then a merge of k rows per partition)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .quantiles import grouped_quantiles


def fraud_by_type(df: DataFrame, key: str = "type", target: str = "isFraud") -> DataFrame:
    """Count, frauds and rate per type, highest rate first."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                F.sum(target).cast("long").alias("frauds"),
                                F.avg(F.col(target).cast("double")).alias("fraud_rate"))
            .orderBy(F.desc("fraud_rate"), F.asc(key)))


def fraud_type_summary(df: DataFrame, key: str = "type", target: str = "isFraud",
                       amount: str = "amount", method: str = "exact") -> DataFrame:
    """Per type: transactions, frauds, mean and median amount, rate."""
    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("transactions"),
                               F.sum(target).cast("long").alias("frauds"),
                               F.avg(amount).alias("avg_amount"))
    med = grouped_quantiles(df, {"median_amount": (amount, 0.5)}, [key], method=method)
    return (base.join(med, key)
            .withColumn("fraud_rate", F.col("frauds") / F.col("transactions"))
            .orderBy(F.desc("fraud_rate"), F.asc(key)))


def fraud_type_sums(df: DataFrame, key: str = "type", target: str = "isFraud",
                    amount: str = "amount") -> DataFrame:
    """D3: mergeable sums (partial per partition, merged in the final
    aggregate), then mean and rate from the sums."""
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("transactions"),
                            F.sum(target).cast("long").alias("frauds"),
                            F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount_sum"))
    return (s.select(key, "transactions", "frauds",
                     F.col("amount_sum").cast("double").alias("amount_sum"),
                     (F.col("amount_sum") / F.col("transactions")).cast("double").alias("amount_mean"),
                     (F.col("frauds") / F.col("transactions")).alias("fraud_rate"))
            .orderBy(F.desc("fraud_rate"), F.asc(key)))


def class_summary(df: DataFrame, target: str = "isFraud") -> DataFrame:
    """Count per class and share of all rows (the share's window runs
    over the two-row aggregate, not over the data)."""
    counts = df.groupBy(F.col(target).cast("int").alias(target)).agg(F.count(F.lit(1)).alias("transactions"))
    return (counts.withColumn("label", F.when(F.col(target) == 1, "Fraude").otherwise("Normal"))
            .withColumn("share", F.col("transactions") / F.sum("transactions").over(Window.partitionBy()))
            .orderBy(target))


def positive_rate(df: DataFrame, target: str = "isFraud") -> DataFrame:
    """D5."""
    return df.agg(F.avg(F.col(target).cast("double")).alias("positive_rate"),
                  F.count(F.lit(1)).alias("rows"))


def time_bucket_summary(df: DataFrame, step: str = "step", target: str = "isFraud",
                        amount: str = "amount", hours: int = 24) -> DataFrame:
    """Per 24-step bucket: count, frauds, mean amount, rate."""
    b = F.floor(F.col(step) / hours).cast("int").alias("step_bucket")
    return (df.groupBy(b).agg(F.count(F.lit(1)).alias("transactions"),
                              F.sum(target).cast("long").alias("frauds"),
                              F.avg(amount).alias("amount"))
            .withColumn("fraud_rate", F.col("frauds") / F.col("transactions"))
            .orderBy("step_bucket"))


def frauds_per_step(df: DataFrame, step: str = "step", target: str = "isFraud") -> DataFrame:
    """D7."""
    return df.groupBy(step).agg(F.sum(target).cast("long").alias("n_fraudes")).orderBy(step)


def balance_diagnostics(features: DataFrame, label: str = "label", method: str = "exact") -> DataFrame:
    """Per class: median amount, zero-balance rates, median absolute errors.

    ``features`` carries the C-features and ``label`` (B11)."""
    rates = features.groupBy(label).agg(
        F.avg("is_zero_newbalance_origin").alias("zero_newbalance_origin_rate"),
        F.avg("is_zero_oldbalance_dest").alias("zero_oldbalance_dest_rate"))
    abs_cols = features.select(label, "amount", F.abs("origin_error").alias("abs_origin_error"),
                               F.abs("dest_error").alias("abs_dest_error"))
    med = grouped_quantiles(abs_cols, {"median_amount": ("amount", 0.5),
                                       "abs_origin_error": ("abs_origin_error", 0.5),
                                       "abs_dest_error": ("abs_dest_error", 0.5)}, [label], method=method)
    return rates.join(med, label)


DESCRIBE_STATS = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
             method: str = "exact") -> DataFrame:
    """Pandas ``describe`` per column (and per group): count, mean,
    sample std, min, quartiles, max. Long output: (by..., column, stat...)."""
    by = list(by)
    names = {f"_x{i}": c for i, c in enumerate(columns)}
    # the rows are made once, and stay as wide as they are; only results become long
    wide = stored(df.select(*by, *[F.col(c).cast("double").alias(x) for x, c in names.items()]), "describe-input")
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

    def long(one: DataFrame, kept: Sequence[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{x}_{k}").alias(k) for k in kept]) for x, c in names.items()])
        return one.select(*by, F.explode(rows).alias("_s")).select(*by, "_s.*")

    moments = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[f(x).alias(f"{x}_{k}") for x in names for k, f in stats.items()]).where("_n > 0")
    quarts = grouped_quantiles(wide, {f"{x}_{k}": (x, p) for x in names for k, p in quartiles.items()}, by, method=method)
    return long(moments, list(stats)).join(long(quarts, list(quartiles)), by + ["column"])


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the global min and max (numpy rule:
    the last bin is closed). Bounds enter as scalar subqueries."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / bins
    idx = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), F.lit(bins - 1)))
    return (df.where(x.isNotNull())
            .groupBy(*by, idx.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_start", lo + F.col("bin") * width)
            .withColumn("bin_end", lo + (F.col("bin") + 1) * width)
            .orderBy(*by, "bin"))


def box_stats(df: DataFrame, value: str, by: Sequence[str], method: str = "exact") -> DataFrame:
    """Quartiles, min and max per group (box plot)."""
    q = grouped_quantiles(df, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)},
                          by, method=method)
    mm = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"),
                             F.count(value).alias("n"))
    return mm.join(q, list(by))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair in ONE aggregate pass;
    each pair uses the rows where both are present (pandas' pairwise rule).
    Output long: (col_a, col_b, corr)."""
    aggs, names = [], []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            name = f"{a}|{b}"
            names.append(name)
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(name))
    one = df.agg(*aggs)
    long = one.unpivot([], names, "pair", "corr")
    parts = F.split("pair", r"\|")
    upper = long.select(parts[0].alias("col_a"), parts[1].alias("col_b"), "corr")
    lower = upper.where(F.col("col_a") != F.col("col_b")).select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    return upper.unionByName(lower)


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``value_counts().head(n)``, ties broken by value."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(n))


def column_means(df: DataFrame, columns: Sequence[str], name_col: str, value_col: str) -> DataFrame:
    """Mean of each column, long, largest first."""
    cols = [c for c in columns if c in df.columns]
    one = df.agg(*[F.avg(c).alias(c) for c in cols])
    return one.unpivot([], cols, name_col, value_col).orderBy(F.desc(value_col), F.asc(name_col))


# The columns of a segment profile.
PROFILE_COLUMNS = ["Income", "Age", "Recency", "Total_Spending", "Total_Purchases", "NumWebPurchases",
                   "NumStorePurchases", "NumCatalogPurchases", "NumDealsPurchases",
                   "Campaign_Acceptance_Total"]


def mean_2dp(c: str) -> Column:
    """Mean to 2 decimals, halves away from zero, by integer arithmetic on
    millionths, so that it doesn't depend on the order of summation."""
    total, n = F.sum(F.col(c).cast("decimal(28,6)")), F.count(F.col(c))
    units = (total * F.lit(1_000_000)).cast("decimal(38,0)")
    up = F.abs(units) * 2 + n * 10_000
    whole = (up - up % (n * 20_000)) / (n * 20_000)  # exact: no remainder is left
    return (F.signum(units) * whole.cast("double") / 100).cast("double")


def profile_clusters(df: DataFrame, cluster: str = "cluster",
                     columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Per-cluster means (2 decimals) and size."""
    cols = [c for c in columns if c in df.columns]
    return (df.groupBy(cluster)
            .agg(*[mean_2dp(c).alias(c) for c in cols], F.count(F.lit(1)).alias("cluster_size"))
            .orderBy(cluster))


def minmax_normalise(profiles: DataFrame, columns: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """``(x - min) / (max - min + eps)`` per column over the profile rows.
    The profile table has one row per cluster; bounds come from a window over
    that small table."""
    w = Window.partitionBy()
    return profiles.select(*[c for c in profiles.columns if c not in columns],
                           *[((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + eps))
                             .alias(c) for c in columns])


def segment_shares(profiles: DataFrame, cluster: str = "cluster", size: str = "cluster_size",
                   spend: str = "Total_Spending") -> DataFrame:
    """Share of each segment and the premium flag (arg-max spending)."""
    w = Window.partitionBy()
    return (profiles.withColumn("share", F.col(size) / F.sum(size).over(w))
            .withColumn("is_premium", F.col(cluster) ==
                        F.max_by(F.col(cluster), F.struct(F.col(spend), -F.col(cluster))).over(w)))


def customer_kpis(df: DataFrame, method: str = "exact") -> DataFrame:
    """Customers and median income / spend / purchases."""
    med = grouped_quantiles(df, {"median_income": ("Income", 0.5),
                                 "median_spending": ("Total_Spending", 0.5),
                                 "median_purchases": ("Total_Purchases", 0.5)}, method=method)
    n = df.agg(F.count(F.lit(1))).scalar()
    return med.withColumn("customers", n)


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """Bounded top-k with an explicit, unique ordering."""
    return df.orderBy(*order).limit(n)


def suspicious_examples(features: DataFrame, n: int = 12, tie_key: str = "event_id") -> DataFrame:
    """Top ``n`` by label, amount, |origin error| (all descending)."""
    cols = ["step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
            "newbalanceDest", "isFraud", "origin_error", "dest_error", "amount_to_oldbalance_ratio"]
    keep_cols = [c for c in [tie_key] + cols if c in features.columns]
    out = features.select(*keep_cols, F.abs("origin_error").alias("abs_origin_error"))
    return top_rows(out, [F.desc("isFraud"), F.desc("amount"), F.desc_nulls_last("abs_origin_error"),
                          F.asc(tie_key)], n)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, value)


def preferred_position(column: str, preferred: Sequence[str]) -> list[Column]:
    """Sort keys that put known names first in the given order, then the
    rest by name."""
    pos = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(column))
    return [F.when(pos == 0, F.lit(len(preferred) + 1)).otherwise(pos), F.col(column)]


def side_by_side(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str],
                 left_name: str, right_name: str) -> DataFrame:
    """Two one-row metric tables -> (metric, left, right) by an inner
    equi-join on the metric name."""
    a = left.unpivot([], list(metrics), "metric", left_name)
    b = right.unpivot([], list(metrics), "metric", right_name)
    return a.join(b, "metric")


def nearest_row(df: DataFrame, column: str, target: float) -> DataFrame:
    """The row whose ``column`` is closest to ``target`` (lower value
    wins a tie)."""
    st = F.struct(*[F.col(c) for c in df.columns])
    key = F.struct(-F.abs(F.col(column) - F.lit(target)), -F.col(column))
    return df.agg(F.max_by(st, key).alias("_r")).select("_r.*")
