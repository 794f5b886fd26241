"""Stored, mergeable summaries for monitoring (inventory I4, I5, I9).

Each day leaves three small tables in a folder: quantile sketches of its
numbers, counts of its categories, and its scores counted by bin and label. A
day is summarised once; every later check merges the days it needs and never
reads their rows again. A day saved again replaces itself.

* Numbers: KLL sketches of ``k`` values. Up to ``k`` values a window is exact;
  beyond that a share between two cut points is off by at most ``share_error``
  (for about 99 of 100 shares).
* Scores: equal bins over 0 to 1. Counts at a bin's edge are exact; the average
  precision lies between the orders in which a bin's positives come last and
  first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_metrics import cumulative_counts
from .monitoring import DECILES, PSI_EPS

K = 8192
BINS = 1000
VALUES, CATEGORIES, SCORES = "values", "categories", "scores"


def share_error(k: int = K) -> float:
    """How far a share of a sketch in estimation mode may be off."""
    return 2.446 / k ** 0.9433


def _long(df: DataFrame, day: Column, columns: Sequence[str], kind: str) -> DataFrame:
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in columns]))
    return df.select(day.cast("int").alias("day"), one.alias("_s")).select("day", "_s.feature", "_s.v").where("day is not null and v is not null")


def _save(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def save_days(df: DataFrame, folder: str, day: Column, numbers: Sequence[str] = (), categories: Sequence[str] = (),
              score: str | None = None, label: str | None = None, k: int = K) -> None:
    """Summaries of the days of ``df``, saved under ``folder``. Nulls and NaN
    are left out, and so are scores outside 0 to 1 and rows without a day."""
    if numbers:
        v = _long(df, day, numbers, "double").where(~F.isnan("v"))
        _save(v.groupBy("day", "feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch")), f"{folder}/{VALUES}")
    if categories:
        _save(_long(df, day, categories, "string").groupBy("day", "feature", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n")), f"{folder}/{CATEGORIES}")
    if score:
        s, y = F.col(score).cast("double"), F.col(label).cast("int")
        # a score that is a bin's edge but for the last bits belongs above it
        at = F.least(F.floor(s * BINS + 1e-9), F.lit(BINS)).cast("int")
        rows = df.select(day.cast("int").alias("day"), at.alias("bin"), (y == 1).alias("_y"), s.alias("_s")).where("day is not null and _s between 0 and 1 and _y is not null")
        _save(rows.groupBy("day", "bin").agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg")), f"{folder}/{SCORES}")


def merged_values(spark: SparkSession, folder: str, days: Column) -> DataFrame:
    """(feature, n, sketch) of the days that ``days``, a condition on ``day``, picks."""
    t = spark.read.parquet(f"{folder}/{VALUES}").where(days)
    return t.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _counts(spark: SparkSession, folder: str, days: Column) -> DataFrame:
    return spark.read.parquet(f"{folder}/{CATEGORIES}").where(days).groupBy("feature", "value").agg(F.sum("n").alias("n"))


def _term(p: Column, q: Column) -> Column:
    return (q - p) * F.log(q / p)


def psi_from_sketches(spark: SparkSession, folder: str, reference: Column, current: Column, probs: Sequence[float] = DECILES,
                      eps: float = PSI_EPS, k: int = K) -> DataFrame:
    """I4: (feature, psi, psi_error, alert). Bins are cut at the reference
    sketch's quantiles (values that occur); ``psi_error`` bounds the distance to
    the index of the exact shares between the same cut points. It is 0 while
    both windows hold up to ``k`` values. Categories are counted exactly."""
    floor_ = lambda c: F.greatest(c, F.lit(eps))
    ref = merged_values(spark, folder, reference).select("feature", F.col("n").alias("np"), F.col("sketch").alias("_r"))
    cur = merged_values(spark, folder, current).select("feature", F.col("n").alias("nq"), F.col("sketch").alias("_c"))
    # a feature's cut points: ranks are asked for at literals
    deciles = F.kll_sketch_get_quantile_double("_r", F.array(*[F.lit(float(p)) for p in probs]))
    cuts = {r["feature"]: sorted(set(r["q"])) for r in ref.select("feature", deciles.alias("q")).collect()}

    def shares(sketch: str) -> Column:
        up = F.lit(None).cast("array<double>")
        for feature, at in cuts.items():
            here = F.concat(F.kll_sketch_get_rank_double(sketch, F.array(*[F.lit(x) for x in at])), F.array(F.lit(1.0)))
            up = F.when(F.col("feature") == feature, here).otherwise(up)
        return F.transform(up, lambda v, i: v - F.when(i == 0, F.lit(0.0)).otherwise(F.get(up, i - 1)))

    both = ref.join(cur, "feature").withColumns({"_p": shares("_r"), "_q": shares("_c")})
    bins = both.select("feature", "np", "nq", F.explode(F.arrays_zip("_p", "_q")).alias("b")).select(
        "feature", F.col("b._p").alias("p"), F.col("b._q").alias("q"),
        F.when(F.col("np") > k, share_error(k)).otherwise(0.0).alias("dp"), F.when(F.col("nq") > k, share_error(k)).otherwise(0.0).alias("dq"))
    p, q = floor_(F.col("p")), floor_(F.col("q"))
    (p0, p1), (q0, q1) = ((floor_(F.col(c) - F.col(f"d{c}")), floor_(F.col(c) + F.col(f"d{c}"))) for c in "pq")
    # the term is convex: its largest value is at a corner, its least too, or 0 where the shares may be equal
    corners = [_term(a, b) for a in (p0, p1) for b in (q0, q1)]
    low = F.when((p0 <= q1) & (q0 <= p1), F.lit(0.0)).otherwise(F.least(*corners))
    numbers = bins.groupBy("feature").agg(F.sum(_term(p, q)).alias("psi"), F.sum(F.greatest(F.greatest(*corners) - _term(p, q), _term(p, q) - low)).alias("psi_error"))
    numbers = numbers.withColumn("psi_error", F.when(F.col("psi_error") < 1e-12, 0.0).otherwise(F.col("psi_error")))
    out = numbers
    if _has(spark, folder, CATEGORIES):
        a, b = (_counts(spark, folder, w) for w in (reference, current))
        sizes = lambda t, name: t.groupBy("feature").agg(F.sum("n").alias(name))
        j = (a.withColumnRenamed("n", "p").join(b.withColumnRenamed("n", "q"), ["feature", "value"], "full")
             .join(sizes(a, "np"), "feature").join(sizes(b, "nq"), "feature"))
        share = lambda c, n: floor_(F.coalesce(F.col(c) / F.col(n), F.lit(0.0)))
        out = out.unionByName(j.groupBy("feature").agg(F.sum(_term(share("p", "np"), share("q", "nq"))).alias("psi"), F.lit(0.0).alias("psi_error")))
    return out.withColumn("alert", F.col("psi") > 0.2)


def _has(spark: SparkSession, folder: str, name: str) -> bool:
    from ..sources.files import exists
    return exists(spark, f"{folder}/{name}")


def drift_from_sketches(spark: SparkSession, folder: str, reference: Column, current: Column, rates: Mapping[str, tuple[str, str]],
                        medians: Mapping[str, str], limit: float = 0.20) -> DataFrame:
    """Relative change of shares (name -> feature, value) and of medians
    (name -> feature; the lower middle value) between two windows."""
    def window(days: Column, name: str) -> DataFrame:
        counts, out = _counts(spark, folder, days), None
        for metric, (feature, value) in rates.items():
            c = counts.where(F.col("feature") == feature).agg(
                (F.coalesce(F.sum(F.when(F.col("value") == value, F.col("n"))), F.lit(0)) / F.sum("n")).alias(name)).select(F.lit(metric).alias("metric"), name)
            out = c if out is None else out.unionByName(c)
        for metric, feature in medians.items():
            m = merged_values(spark, folder, days).where(F.col("feature") == feature).select(F.lit(metric).alias("metric"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias(name))
            out = m if out is None else out.unionByName(m)
        return out

    j = window(reference, "reference").join(window(current, "current"), "metric", "full")
    change = F.try_divide(F.col("current") - F.col("reference"), F.abs("reference"))
    return j.withColumn("relative_change", change).withColumn("alert", F.abs(change) > limit)


def quality_from_sketches(spark: SparkSession, folder: str, period: Column, threshold: float, baseline: Column | None = None,
                          drop: float = 0.05) -> DataFrame:
    """By ``period`` (an expression on ``day``) recall and precision at a
    threshold on a bin's edge, and the average precision, with scores of one bin
    as ties, and its least and largest possible value. An alert is raised when
    it falls by more than ``drop`` under ``baseline``."""
    edge = threshold * BINS
    if abs(edge - round(edge)) > 1e-9:
        raise ValueError("the threshold is no bin's edge")
    t = spark.read.parquet(f"{folder}/{SCORES}").withColumn("period", period)
    counts = t.groupBy("period", F.col("bin").cast("double").alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = cumulative_counts(counts, ["period"])
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    # at most: every positive is counted where the bin's positives are in and none of its negatives
    most = F.when(pos > 0, pos * tp / (tp + before_fp)).otherwise(0.0)
    # at least: the positives one by one after the negatives, a sum bounded by an integral
    least = F.when(pos > 0, pos - fp * F.log((before_tp + fp + pos) / F.greatest(before_tp + fp, F.lit(1e-9)))).otherwise(0.0)
    above = F.col("score") >= round(edge)
    agg = cum.groupBy("period").agg(
        F.sum("pos").alias("_P"), F.sum(F.when(above, pos).otherwise(0.0)).alias("_tp"), F.sum(F.when(above, neg).otherwise(0.0)).alias("_fp"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp)).otherwise(0.0)).alias("_ap"), F.sum(F.greatest(least, F.lit(0.0))).alias("_low"), F.sum(most).alias("_high"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    agg = agg.withColumn("_alerts", F.col("_tp") + F.col("_fp")).withColumn("_P", F.col("_P").cast("double"))
    out = agg.select("period", ratio("_tp", "_P").alias("recall"), ratio("_tp", "_alerts").alias("precision"), F.try_divide("_ap", "_P").alias("pr_auc"),
                     F.try_divide("_low", "_P").alias("pr_auc_low"), F.try_divide("_high", "_P").alias("pr_auc_high"))
    return out if baseline is None else out.withColumn("pr_auc_alert", F.col("pr_auc") < baseline * (1 - drop))
