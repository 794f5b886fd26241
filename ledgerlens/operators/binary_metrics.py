"""Exact binary-classification metrics (inventory F1-F15).

The shared core:

* ``score_counts``: one row per distinct score with positive / negative
  counts (and the money at stake). A grouped aggregate with map-side
  combine, so a score held by a third of the rows is one partial row per task.
* ``cumulative_counts``: running true/false positives from the highest score
  down, computed with the chunked prefix sum of ``windows`` (chunks are score
  ranges of width 1/``SCORE_CHUNKS``), never a single-partition window over
  the data.
* ``threshold_counts``: for a list of thresholds each distinct score is
  assigned the number of thresholds at or below it with an array ``filter``
  (JVM-side), counts are summed per slot and accumulated over the (tiny)
  threshold list. No score x threshold product is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .windows import exclusive_running_sums

SCORE_CHUNKS = 512


def score_counts(df: DataFrame, score: str = "proba", label: str = "y",
                 amount: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("int")
    aggs = [F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")]
    if amount:
        aggs.append(F.sum(F.when(y == 1, F.col(amount).cast("decimal(18,2)"))
                          .otherwise(F.lit(0).cast("decimal(18,2)"))).alias("pos_amount"))
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(*aggs)


def with_score_chunk(counts: DataFrame, score: str = "score", chunks: int = SCORE_CHUNKS) -> DataFrame:
    """Adds ``_chunk``, which falls as the score grows. Chunks are cut at
    quantiles of the distinct scores, so crowded scores don't share one; the
    chunk is found by binary search in the array of cuts."""
    cuts = counts.agg(F.percentile_approx(score, [i / chunks for i in range(1, chunks)], 10 * chunks).alias("c")).scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((chunks - 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(F.col("_cuts"), i + s - 1) <= F.col(score), i + s).otherwise(i))
    return counts.withColumn("_cuts", cuts).withColumn("_chunk", -at).drop("_cuts")


def cumulative_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``tp``/``fp``: positives / negatives with score >= this score. The
    counts, a row a score, are written once: the cuts, the windows and the
    totals read them and not the rows."""
    return _cumulative(with_score_chunk(stored(counts, "score-counts")), by).drop("_chunk")


def _cumulative(c: DataFrame, by: Sequence[str]) -> DataFrame:
    c = exclusive_running_sums(c, list(by), "_chunk", [F.desc("score")], {"pos": "_tp_before", "neg": "_fp_before"})
    return (c.withColumn("tp", F.col("_tp_before") + F.col("pos"))
            .withColumn("fp", F.col("_fp_before") + F.col("neg"))
            .drop("_tp_before", "_fp_before"))


def ranking_metrics(df: DataFrame, score: str = "proba", label: str = "y",
                    by: Sequence[str] = ()) -> DataFrame:
    """F2 + F3: tie-aware ROC-AUC (trapezoids between distinct scores) and
    average precision (sum of recall steps times precision), one row (per
    group with ``by``: e.g. one group per model)."""
    cum = cumulative_counts(score_counts(df, score, label, by=by), by)
    # neg * (tp_prev + tp) summed exactly (decimal: the product can pass 2^63)
    trap = (F.col("neg").cast("decimal(38,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(38,0)"))
    ap_term = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    tot = cum.groupBy(*by).agg(F.sum(trap).alias("_trap"), F.sum(ap_term).alias("_ap"),
                               F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    # undefined without positives (or negatives): null
    return tot.select(*by,
        F.try_divide(F.col("_trap").cast("double"), 2.0 * F.col("_P") * F.col("_N")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.col("_P").cast("double")).alias("pr_auc"))


def curve_points(df: DataFrame, score: str = "proba", label: str = "y") -> DataFrame:
    """ROC and PR curve points, one per distinct score."""
    counts = stored(score_counts(df, score, label), "score-counts")
    return _rates(_cumulative(with_score_chunk(counts), ()), counts)


def _rates(cum: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    P = counts.agg(F.sum("pos")).scalar()
    N = counts.agg(F.sum("neg")).scalar()
    return cum.select(
        F.col("score").alias("threshold"), "tp", "fp",
        (F.col("tp") / P).alias("tpr"), (F.col("fp") / N).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / P).alias("recall"), *more)


def curve_corners(df: DataFrame, score: str = "proba", label: str = "y", steps: int | None = None) -> DataFrame:
    """F4 without redundant points: those at which the walk of (fp, tp) from
    the highest score down turns, and its end (``on_roc``), and those that bound
    a change of recall (``on_pr``). The area under the ROC polygon through the
    kept points (from the origin on) and the average precision over them are
    those of all points.

    A point looks at the step after it; at the border of a chunk that is the
    first step of the next one, from a table of a row a chunk. With ``steps``
    the walk is cut in so many stretches of equal length in both rates and each
    keeps its last turn, so that there are at most ``steps`` + 1 ROC points; the
    area then changes by 2 / ``steps`` at most."""
    counts = stored(score_counts(df, score, label), "score-counts")
    c = _cumulative(with_score_chunk(counts), ())
    step = F.struct("pos", "neg")
    firsts = c.groupBy("_chunk").agg(F.max_by(step, "score").alias("_first"))
    after = firsts.select("_chunk", F.lead("_first").over(Window.partitionBy().orderBy("_chunk")).alias("_border"))  # at most SCORE_CHUNKS rows
    inside = F.lead(step).over(Window.partitionBy("_chunk").orderBy(F.desc("score")))
    c = c.withColumn("_next", inside).join(after, "_chunk").withColumn("_next", F.coalesce("_next", "_border"))
    big = lambda x: x.cast("decimal(19,0)")
    turns = big(F.col("pos")) * big(F.col("_next.neg")) != big(F.col("_next.pos")) * big(F.col("neg"))
    last = F.col("_next").isNull()
    c = c.withColumn("on_roc", last | turns).withColumn("on_pr", last | (F.col("pos") > 0) | (F.col("_next.pos") > 0))
    if steps is not None:
        total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.struct("p", "n")).scalar()
        far = F.coalesce(F.try_divide(F.col("tp"), total["p"]), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("fp"), total["n"]), F.lit(0.0))
        c = c.withColumn("_at", F.least(F.floor(far / 2 * steps), F.lit(steps)))
        ends = c.where("on_roc").groupBy("_at").agg(F.min("score").alias("score"), F.lit(True).alias("_kept"))
        c = c.join(ends, ["_at", "score"], "left").withColumn("on_roc", F.coalesce("_kept", F.lit(False)))
    return _rates(c.where("on_roc or on_pr"), counts, "on_roc", "on_pr")


def confusion_matrix(df: DataFrame, threshold: float, score: str = "proba", label: str = "y") -> DataFrame:
    """F5."""
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    return (df.groupBy(F.col(label).cast("int").alias("actual"), pred.alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def _metric_cols(tp, fp, fn, tn):
    tp, fp, fn, tn = [c.cast("double") for c in (tp, fp, fn, tn)]
    zero = F.lit(0.0)
    return {
        "accuracy": (tp + tn) / (tp + fp + fn + tn),
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero),
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(zero),
    }


def threshold_counts(df: DataFrame, thresholds: Sequence[float], score: str = "proba",
                     label: str = "y", amount: str | None = None) -> DataFrame:
    """Per threshold t: tp, fp, fn, tn (prediction = score >= t), and the
    positive money missed (``fn_amount``) when ``amount`` is given."""
    spark = df.sparkSession
    ts = sorted(float(t) for t in thresholds)
    counts = score_counts(df, score, label, amount)
    arr = F.array(*[F.lit(t) for t in ts])
    slot = F.size(F.filter(arr, lambda t: t <= F.col("score")))
    aggs = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    if amount:
        aggs.append(F.sum("pos_amount").alias("pos_amount"))
    per_slot = counts.groupBy(slot.alias("slot")).agg(*aggs)
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(ts, start=1)], "slot int, threshold double")
    # grid has len(thresholds) literal rows; slots are 0..len(thresholds).
    full = (spark.range(0, len(ts) + 1).select(F.col("id").cast("int").alias("slot"))
            .join(per_slot, "slot", "left").fillna(0, ["pos", "neg"]))
    if amount:
        full = full.withColumn("pos_amount", F.coalesce("pos_amount", F.lit(0).cast("decimal(28,2)")))
    w_all = Window.partitionBy()
    w_up = Window.partitionBy().orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    full = (full.withColumn("P", F.sum("pos").over(w_all)).withColumn("N", F.sum("neg").over(w_all))
            .withColumn("tp", F.sum("pos").over(w_up)).withColumn("fp", F.sum("neg").over(w_up)))
    if amount:
        full = (full.withColumn("_amt_up", F.sum("pos_amount").over(w_up))
                .withColumn("_amt_all", F.sum("pos_amount").over(w_all)))
    out = grid.join(full, "slot").select(
        "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
        (F.col("N") - F.col("fp")).alias("tn"), "P", "N",
        *([(F.col("_amt_all") - F.col("_amt_up")).alias("fn_amount")] if amount else []))
    return out


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], score: str = "proba",
                    label: str = "y") -> DataFrame:
    """F8: precision, recall, F1 and alert count per threshold."""
    c = threshold_counts(df, thresholds, score, label)
    m = _metric_cols(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return c.select("threshold", m["precision"].alias("precision"), m["recall"].alias("recall"),
                    m["f1"].alias("f1"), (F.col("tp") + F.col("fp")).alias("alerts"))


CALIBRATION_GRID = [i / 100 for i in range(5, 100)]


def best_threshold(df: DataFrame, min_recall: float = 0.75, score: str = "proba", label: str = "y",
                   default: float = 0.5) -> DataFrame:
    """among t = 0.05 .. 0.99 with recall >= ``min_recall`` (recall over
    max(P, 1)), the highest F1; the lowest t wins a tie; ``default`` when
    none qualifies."""
    c = threshold_counts(df, CALIBRATION_GRID, score, label)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    recall = F.col("tp") / F.greatest(F.col("P"), F.lit(1))
    ok = c.where(recall >= min_recall).select("threshold", f1.alias("f1"))
    best = ok.agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("t"),
                  F.max("f1").alias("best_f1"))
    return best.select(F.coalesce("t", F.lit(default)).alias("threshold"), "best_f1")


def classification_metrics(df: DataFrame, threshold: float | F.Column, score: str = "proba",
                           label: str = "y") -> DataFrame:
    """F1-F3 in one row: accuracy, precision, recall, F1 at ``threshold``,
    ROC-AUC and average precision over the scores."""
    t = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    y = F.col(label).cast("int")
    pred = F.col(score) >= t
    conf = df.agg(F.count_if((y == 1) & pred).alias("tp"), F.count_if((y != 1) & pred).alias("fp"),
                  F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y != 1) & ~pred).alias("tn"))
    m = _metric_cols(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    rank = ranking_metrics(df, score, label).select(F.struct("roc_auc", "pr_auc")).scalar()
    return conf.select(*[v.alias(k) for k, v in m.items()],
                       rank.getField("roc_auc").alias("roc_auc"),
                       rank.getField("pr_auc").alias("pr_auc"),
                       (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("test_size"),
                       ((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
                       .alias("positive_rate_test"))


def estimated_confusion(metrics: DataFrame) -> DataFrame:
    """confusion counts estimated back from rates and sizes."""
    pos = F.col("positive_rate_test") * F.col("test_size")
    tp = pos * F.col("recall")
    fp = F.when(F.col("precision") == 0, F.lit(0.0)).otherwise(
        F.greatest(tp / F.col("precision") - tp, F.lit(0.0)))
    out = metrics.select("*", pos.alias("positives"), tp.alias("tp_est"),
                         F.greatest(pos - tp, F.lit(0.0)).alias("fn_est"), fp.alias("fp_est"))
    out = out.withColumn("alerts_est", F.col("tp_est") + F.col("fp_est"))
    tp_r, fn_r = F.round("tp_est"), F.round(F.col("positives") - F.round("tp_est"))
    fp_r = F.round("fp_est")
    return out.withColumn("tn_est", F.round(F.col("test_size") - tp_r - fn_r - fp_r))


def error_type(score: str = "proba", label: str = "y", threshold: float | F.Column = 0.5) -> F.Column:
    """correct / false_negative / false_positive."""
    t = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label).cast("int")
    return (F.when((y == 1) & ~pred, "false_negative")
            .when((y == 0) & pred, "false_positive").otherwise("correct"))


def error_cases(df: DataFrame, threshold: float, key: str, score: str = "proba", label: str = "y",
                max_cases: int = 10, low_threshold: float = 0.5) -> DataFrame:
    """the ``max_cases`` false negatives with the lowest score; all
    false positives by score; when there are none, the ``max_cases``
    negatives with score >= ``low_threshold`` ("quasi" false positives).
    The fallback is expressed in the plan (no driver-side branch)."""
    et = df.withColumn("error_type", error_type(score, label, threshold))
    fn = (et.where(F.col("error_type") == "false_negative")
          .orderBy(F.asc(score), F.asc(key)).limit(max_cases)
          .withColumn("case_label", F.lit("false_negative")))
    fp = et.where(F.col("error_type") == "false_positive").withColumn("case_label", F.lit("false_positive"))
    n_fp = et.agg(F.count_if(F.col("error_type") == "false_positive")).scalar()
    quasi = (et.where((F.col(label).cast("int") == 0) & (F.col(score) >= low_threshold) & (n_fp == 0))
             .orderBy(F.desc(score), F.asc(key)).limit(max_cases)
             .withColumn("case_label", F.lit(f"quasi_false_positive_threshold_{low_threshold}")))
    return fn.unionByName(fp).unionByName(quasi)


def error_summary(df: DataFrame, threshold: float, score: str = "proba", label: str = "y") -> DataFrame:
    """test size, FN / FP counts, recall and precision at the threshold."""
    et = error_type(score, label, threshold)
    y = F.col(label).cast("int")
    pred = (F.col(score) >= F.lit(float(threshold))).cast("int")
    return df.agg(
        F.lit(float(threshold)).alias("threshold"),
        F.count(F.lit(1)).alias("test_size"),
        F.count_if(et == "false_negative").alias("false_negatives"),
        F.count_if(et == "false_positive").alias("false_positives"),
        F.avg(F.when(y == 1, pred)).alias("recall_at_threshold"),
        F.coalesce(F.avg(F.when(pred == 1, y)), F.lit(0.0)).alias("precision_at_threshold"))


def cost_scenarios(df: DataFrame, thresholds: Sequence[float], selected: float | F.Column | None,
                   cost_per_fp: float = 25.0, score: str = "proba", label: str = "y",
                   amount: str = "amount") -> DataFrame:
    """per threshold: FN money lost, FP review cost, total, and whether
    it is the selected threshold."""
    c = threshold_counts(df, thresholds, score, label, amount)
    fp_cost = F.col("fp") * F.lit(float(cost_per_fp))
    fn_loss = F.col("fn_amount").cast("double")
    if selected is None:
        sel = F.lit(False)
    else:
        st = selected if isinstance(selected, F.Column) else F.lit(float(selected))
        sel = F.abs(F.col("threshold") - st) < 0.001
    return c.select(
        "threshold", F.col("fn").alias("false_negatives"), F.col("fp").alias("false_positives"),
        (F.col("tp") / F.greatest(F.col("P"), F.lit(1))).alias("recall"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        fn_loss.alias("fn_financial_loss_units"), fp_cost.alias("fp_operational_cost_eur"),
        (fn_loss + fp_cost).alias("total_cost_eur_equivalent"), sel.alias("is_selected_threshold"))


def risk_tier(score: str = "proba", threshold: float = 0.5) -> F.Column:
    """alert at t, watch at t/2, low below."""
    s = F.col(score)
    return (F.when(s >= threshold, "alert").when(s >= threshold / 2, "watch").otherwise("low"))


def review_policy(score: str = "proba", tx_type: str = "type", alert: float = 0.67, review: float = 0.50,
                  risky=("TRANSFER", "CASH_OUT")) -> F.Column:
    """alert above ``alert``; manual review between ``review`` and
    ``alert`` for risky types; standard otherwise."""
    s = F.col(score)
    return (F.when(s >= alert, "alert")
            .when((s >= review) & F.col(tx_type).isin(*risky), "review").otherwise("standard"))
