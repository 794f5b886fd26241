"""Sampling / splitting (E) and classification-evaluation (F) queries over
the transactions (T) and the scored rows (P)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import binary_metrics as M
from ..operators import sampling as E
from ..operators.quantiles import settling
from ..session import stored
from .catalog import REGISTRY, P, T, X, r6, register

HASH_SQL = "CAST(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 13)) AS BIGINT)"
H_EVENT = HASH_SQL.format(k="event_id")

# -- E ---------------------------------------------------------------------


@register("sample_rows", f"""
SELECT * EXCLUDE (h) FROM (SELECT *, {H_EVENT} h FROM t) ORDER BY h LIMIT 1000""", ("t",))
def q_sample_rows(spark, sf):
    """1000 reproducible rows (hash of seed and event id)."""
    return E.sample_n(T(spark, sf), 1000, "event_id")


_SPLIT_SQL = f"""
SELECT event_id, isFraud,
  CASE WHEN rn <= ceil(n * 0.15) THEN 'test'
       WHEN rn <= ceil(n * 0.15) + ceil((n - ceil(n * 0.15)) * 0.1765) THEN 'val' ELSE 'train' END split
FROM (SELECT event_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {H_EVENT}) rn,
             count(*) OVER (PARTITION BY isFraud) n FROM t)"""


@register("stratified_split", _SPLIT_SQL, ("t",))
def q_stratified_split(spark, sf):
    """Train / val / test by class with exact per-class sizes."""
    return E.stratified_split(X(spark, sf).select("event_id", "isFraud"), "isFraud", "event_id")


@register("stratified_sample", f"""
WITH sizes AS (SELECT isFraud, count(*) nc FROM t GROUP BY 1),
a AS (SELECT isFraud, nc, sum(nc) OVER () big_n, nc * 2000 / sum(nc) OVER () ex FROM sizes),
b AS (SELECT *, floor(ex) base, ex - floor(ex) rem FROM a),
c AS (SELECT *, 2000 - sum(base) OVER () short, row_number() OVER (ORDER BY rem DESC, isFraud) rk FROM b),
k AS (SELECT isFraud, CASE WHEN big_n <= 2000 THEN nc ELSE base + CASE WHEN rk <= short THEN 1 ELSE 0 END END k FROM c)
SELECT event_id, t2.isFraud FROM (
  SELECT event_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {H_EVENT}) rn FROM t) t2
JOIN k ON t2.isFraud = k.isFraud WHERE rn <= k""", ("t",))
def q_stratified_sample(spark, sf):
    """At most 2000 rows with the class shares kept."""
    return E.stratified_sample(X(spark, sf).select("event_id", "isFraud"), "isFraud", "event_id", 2000)


@register("temporal_split", f"""
WITH c AS (SELECT quantile_cont(step, 0.7) c1, quantile_cont(step, {0.7 + 0.15!r}) c2 FROM t),
s AS (SELECT t.*, CASE WHEN step <= c1 THEN 'train' WHEN step <= c2 THEN 'val' ELSE 'test' END split FROM t, c)
SELECT split, count(*) "rows", CAST(sum(isFraud) AS BIGINT) positives, min(step) min_step, max(step) max_step,
       round(avg(isFraud), 6) positive_rate
FROM s GROUP BY split""", ("t",))
def q_temporal_split(spark, sf):
    """Time-ordered split at the 0.70 and 0.85 quantiles of ``step``."""
    s = E.temporal_split(X(spark, sf), "step", 0.70, 0.15)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("isFraud").cast("long").alias("positives"),
                                  F.min("step").alias("min_step"), F.max("step").alias("max_step"),
                                  r6(F.avg("isFraud")).alias("positive_rate"))


@register("positives_plus_sample", f"""
SELECT event_id, isFraud FROM t WHERE isFraud = 1
UNION ALL
(SELECT event_id, isFraud FROM t WHERE isFraud <> 1 ORDER BY {H_EVENT} LIMIT 1000)""", ("t",))
def q_positives_plus_sample(spark, sf):
    """E5: all frauds plus 1000 sampled normal rows."""
    return E.keep_positives_sample(X(spark, sf).select("event_id", "isFraud"), "isFraud", "event_id", 1000)


# -- F ---------------------------------------------------------------------

_CUM = """
sc AS (SELECT proba score, count_if(y = 1) pos, count_if(y <> 1) neg FROM p GROUP BY proba),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tp,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) fp FROM sc),
rk AS (SELECT CAST(sum(CAST(neg AS DECIMAL(38,0)) * CAST(2 * tp - pos AS DECIMAL(38,0))) AS DOUBLE)
                / nullif(2.0 * sum(pos) * sum(neg), 0) roc_auc,
              sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) pr_auc FROM cum)"""

_CONF = """
conf AS (SELECT count_if(y = 1 AND proba >= {t}) tp, count_if(y <> 1 AND proba >= {t}) fp,
                count_if(y = 1 AND proba < {t}) fn, count_if(y <> 1 AND proba < {t}) tn FROM p)"""

_METRICS_SELECT = """
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) "precision",
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) f1,
       round(roc_auc, 6) roc_auc, round(pr_auc, 6) pr_auc, tp + fp + fn + tn test_size,
       round((tp + fn) / (tp + fp + fn + tn), 6) positive_rate_test
FROM conf, rk"""


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("classification_metrics", "WITH " + _CUM + "," + _CONF.format(t=0.5) + _METRICS_SELECT, ("p",))
def q_classification_metrics(spark, sf):
    """F1-F3 at threshold 0.5."""
    return _rounded(M.classification_metrics(P(spark, sf), 0.5))


@register("roc_pr_curve", "WITH " + _CUM + """
SELECT score threshold, tp, fp, round(tp / (SELECT sum(pos) FROM sc), 6) tpr,
       round(fp / (SELECT sum(neg) FROM sc), 6) fpr, round(tp / (tp + fp), 6) "precision",
       round(tp / (SELECT sum(pos) FROM sc), 6) recall FROM cum""", ("p",))
def q_roc_pr_curve(spark, sf):
    """one ROC / PR point per distinct score."""
    c = M.curve_points(P(spark, sf))
    return c.select("threshold", "tp", "fp", *[r6(x).alias(x) for x in ("tpr", "fpr", "precision", "recall")])


@register("roc_pr_corners", "WITH " + _CUM + """,
turn AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) npos, lead(neg) OVER (ORDER BY score DESC) nneg FROM cum),
kept AS (SELECT *, npos IS NULL OR pos * nneg <> npos * neg on_roc, npos IS NULL OR pos > 0 OR npos > 0 on_pr FROM turn)
SELECT score threshold, tp, fp, round(tp / (SELECT sum(pos) FROM sc), 6) tpr, round(fp / (SELECT sum(neg) FROM sc), 6) fpr,
       round(tp / (tp + fp), 6) "precision", round(tp / (SELECT sum(pos) FROM sc), 6) recall, on_roc, on_pr FROM kept WHERE on_roc OR on_pr""", ("p",))
def q_roc_pr_corners(spark, sf):
    """F4 without redundant points of either curve."""
    c = M.curve_corners(P(spark, sf))
    return c.select("threshold", "tp", "fp", *[r6(x).alias(x) for x in ("tpr", "fpr", "precision", "recall")], "on_roc", "on_pr")


@register("confusion_matrix", """
SELECT CAST(y AS INT) actual, CAST(proba >= 0.5 AS INT) predicted, count(*) "count" FROM p GROUP BY 1, 2""", ("p",))
def q_confusion_matrix(spark, sf):
    """F5 at threshold 0.5."""
    return M.confusion_matrix(P(spark, sf), 0.5)


@register("estimated_confusion", "WITH " + _CUM + "," + _CONF.format(t=0.5) + """,
m AS (SELECT (tp + tn) / (tp + fp + fn + tn) accuracy,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END "precision",
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END recall,
       tp + fp + fn + tn test_size, (tp + fn) / (tp + fp + fn + tn) positive_rate_test FROM conf),
e AS (SELECT *, positive_rate_test * test_size positives, positive_rate_test * test_size * recall tp_est FROM m),
e2 AS (SELECT *, greatest(positives - tp_est, 0) fn_est,
              CASE WHEN "precision" = 0 THEN 0.0 ELSE greatest(tp_est / "precision" - tp_est, 0) END fp_est FROM e)
SELECT round(positives, 6) positives, round(tp_est, 6) tp_est, round(fn_est, 6) fn_est, round(fp_est, 6) fp_est,
       round(tp_est + fp_est, 6) alerts_est,
       round(test_size - round(tp_est) - round(positives - round(tp_est)) - round(fp_est), 6) tn_est
FROM e2""", ("p",))
def q_estimated_confusion(spark, sf):
    """confusion counts rebuilt from the metric rates (as the reporting
    layer does when only rates are stored)."""
    m = M.classification_metrics(P(spark, sf), 0.5)
    e = M.estimated_confusion(m)
    return e.select(*[r6(c).alias(c) for c in ("positives", "tp_est", "fn_est", "fp_est", "alerts_est", "tn_est")])


def _grid_sql(ts):
    return "(VALUES " + ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in ts) + ") g(threshold)"


_BEST_SQL = f"""
bt_c AS (SELECT threshold, count_if(y = 1 AND proba >= threshold) tp, count_if(y <> 1 AND proba >= threshold) fp,
                count_if(y = 1 AND proba < threshold) fn FROM p, {_grid_sql(M.CALIBRATION_GRID)} GROUP BY threshold),
bt_ok AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END f1
          FROM bt_c WHERE tp / greatest(tp + fn, 1) >= 0.75),
bt AS (SELECT coalesce((SELECT threshold FROM bt_ok ORDER BY f1 DESC, threshold LIMIT 1), 0.5) threshold,
              (SELECT max(f1) FROM bt_ok) best_f1)"""


@register("best_threshold", "WITH " + _BEST_SQL + " SELECT threshold, round(best_f1, 6) best_f1 FROM bt", ("p",))
def q_best_threshold(spark, sf):
    """validation threshold with max F1 under recall >= 0.75."""
    return M.best_threshold(P(spark, sf), 0.75).withColumn("best_f1", r6("best_f1"))


CURVE = [float(x) for x in np.linspace(0.05, 0.99, 40)]


@register("threshold_curve", f"""
WITH c AS (SELECT threshold, count_if(y = 1 AND proba >= threshold) tp, count_if(y <> 1 AND proba >= threshold) fp,
                  count_if(y = 1 AND proba < threshold) fn FROM p, {_grid_sql(CURVE)} GROUP BY threshold)
SELECT threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) "precision",
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) f1,
       tp + fp alerts FROM c""", ("p",))
def q_threshold_curve(spark, sf):
    """F8: 40 thresholds between 0.05 and 0.99."""
    s = M.threshold_sweep(P(spark, sf), CURVE)
    return s.select("threshold", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "alerts")


def _cases_sql(t):
    et = (f"CASE WHEN y = 1 AND proba < {t} THEN 'false_negative' "
          f"WHEN y = 0 AND proba >= {t} THEN 'false_positive' ELSE 'correct' END")
    return f"""
WITH e AS (SELECT *, {et} error_type FROM p),
nfp AS (SELECT count_if(error_type = 'false_positive') n FROM e)
(SELECT *, 'false_negative' case_label FROM e WHERE error_type = 'false_negative' ORDER BY proba, event_id LIMIT 10)
UNION ALL
(SELECT *, 'false_positive' case_label FROM e WHERE error_type = 'false_positive')
UNION ALL
(SELECT *, 'quasi_false_positive_threshold_0.5' case_label FROM e
 WHERE y = 0 AND proba >= 0.5 AND (SELECT n FROM nfp) = 0 ORDER BY proba DESC, event_id LIMIT 10)"""


@register("error_cases", _cases_sql(0.87), ("p",))
def q_error_cases(spark, sf):
    """F9 + F10 at 0.87: lowest-scored missed frauds and every false alert."""
    return M.error_cases(P(spark, sf), 0.87, "event_id")


@register("error_cases_quasi", _cases_sql(1.0), ("p",))
def q_error_cases_quasi(spark, sf):
    """F10 with no false positive at all (threshold 1.0): the highest-scored
    normal rows above 0.5 are listed instead."""
    return M.error_cases(P(spark, sf), 1.0, "event_id")


@register("error_summary", """
SELECT CAST(0.9 AS DOUBLE) threshold, count(*) test_size, count_if(y = 1 AND proba < 0.9) false_negatives,
       count_if(y = 0 AND proba >= 0.9) false_positives,
       round(avg(CASE WHEN y = 1 THEN CAST(proba >= 0.9 AS INT) END), 6) recall_at_threshold,
       round(coalesce(avg(CASE WHEN proba >= 0.9 THEN y END), 0), 6) precision_at_threshold FROM p""", ("p",))
def q_error_summary(spark, sf):
    """F11 at 0.9."""
    s = M.error_summary(P(spark, sf), 0.9)
    return (s.withColumn("recall_at_threshold", r6("recall_at_threshold"))
            .withColumn("precision_at_threshold", r6("precision_at_threshold")))


COST_THRESHOLDS = [0.50, 0.67, 0.84]


@register("cost_scenarios", "WITH " + _BEST_SQL + f""",
c AS (SELECT threshold, count_if(y = 1 AND proba >= threshold) tp, count_if(y <> 1 AND proba >= threshold) fp,
             count_if(y = 1 AND proba < threshold) fn,
             CAST(coalesce(sum(CASE WHEN y = 1 AND proba < threshold THEN CAST(amount AS DECIMAL(18,2)) END), 0)
                  AS DOUBLE) fn_amount,
             count_if(y = 1) big_p FROM p, {_grid_sql(COST_THRESHOLDS)} GROUP BY threshold)
SELECT threshold, fn false_negatives, fp false_positives, round(tp / greatest(big_p, 1), 6) recall,
       round(tp / greatest(tp + fp, 1), 6) "precision", fn_amount fn_financial_loss_units,
       CAST(fp * 25.0 AS DOUBLE) fp_operational_cost_eur, fn_amount + CAST(fp * 25.0 AS DOUBLE) total_cost_eur_equivalent,
       abs(threshold - (SELECT threshold FROM bt)) < 0.001 is_selected_threshold FROM c""", ("p",))
def q_cost_scenarios(spark, sf):
    """money lost to missed frauds vs review cost of false alerts, with
    the calibrated threshold (F7) marked as selected."""
    p = P(spark, sf)
    sel = M.best_threshold(p, 0.75).select("threshold").scalar()
    c = M.cost_scenarios(p, COST_THRESHOLDS, sel, 25.0)
    return c.withColumn("recall", r6("recall")).withColumn("precision", r6("precision"))


def _scorers(p):
    """Three deterministic scorers over the same labelled rows."""
    return (p.select("event_id", "y", F.col("proba").alias("fine"),
                     (F.floor(F.col("proba") * 10) / 10).alias("coarse"),
                     ((F.col("step") % 100) / 100).alias("hourly"))
            .unpivot(["event_id", "y"], ["fine", "coarse", "hourly"], "model", "score"))


@register("model_ranking", """
WITH s AS (UNPIVOT (SELECT event_id, y, proba fine, floor(proba * 10) / 10 coarse, (step % 100) / 100 hourly FROM p)
           ON fine, coarse, hourly INTO NAME model VALUE score),
sc AS (SELECT model, score, count_if(y = 1) pos, count_if(y <> 1) neg FROM s GROUP BY model, score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tp,
               sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) fp FROM sc),
rk AS (SELECT model, CAST(sum(CAST(neg AS DECIMAL(38,0)) * CAST(2 * tp - pos AS DECIMAL(38,0))) AS DOUBLE)
                / nullif(2.0 * sum(pos) * sum(neg), 0) roc_auc, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) pr_auc
       FROM cum GROUP BY model)
SELECT model, round(roc_auc, 6) roc_auc, round(pr_auc, 6) pr_auc,
       model = (SELECT model FROM rk ORDER BY pr_auc DESC, model LIMIT 1) is_best FROM rk""", ("p",))
def q_model_ranking(spark, sf):
    """F2/F3 per model and F13: the best model by PR-AUC (ties: first by name)."""
    r = M.ranking_metrics(_scorers(P(spark, sf)), "score", "y", by=["model"])
    best = r.agg(F.min_by("model", F.struct(-F.col("pr_auc"), F.col("model")))).scalar()
    return r.select("model", r6("roc_auc").alias("roc_auc"), r6("pr_auc").alias("pr_auc"),
                    (F.col("model") == best).alias("is_best"))


@register("risk_tiers", """
SELECT CASE WHEN proba >= 0.67 THEN 'alert' WHEN proba >= 0.335 THEN 'watch' ELSE 'low' END tier,
       count(*) n, CAST(sum(y) AS BIGINT) frauds FROM p GROUP BY 1""", ("p",))
def q_risk_tiers(spark, sf):
    """F14 at threshold 0.67."""
    return (P(spark, sf).groupBy(M.risk_tier("proba", 0.67).alias("tier"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("frauds")))


@register("review_policy", """
SELECT CASE WHEN proba >= 0.67 THEN 'alert'
            WHEN proba >= 0.5 AND "type" IN ('purchase', 'error') THEN 'review' ELSE 'standard' END policy,
       "type", count(*) n FROM p GROUP BY 1, 2""", ("p",))
def q_review_policy(spark, sf):
    """review tiers; the risky-type stand-ins of the fixture are
    purchase and error."""
    tier = M.review_policy("proba", "type", 0.67, 0.50, ("purchase", "error"))
    return P(spark, sf).groupBy(tier.alias("policy"), "type").agg(F.count(F.lit(1)).alias("n"))


_HALF_SQL = """
{n} AS (SELECT count_if(y = 1 AND proba >= 0.5) tp, count_if(y <> 1 AND proba >= 0.5) fp,
               count_if(y = 1 AND proba < 0.5) fn, count_if(y <> 1 AND proba < 0.5) tn FROM p WHERE {cond}),
{n}_m AS (SELECT (tp + tn) / (tp + fp + fn + tn) accuracy,
                 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END "precision",
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END recall,
                 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END f1 FROM {n}),
{n}_l AS (UNPIVOT {n}_m ON accuracy, "precision", recall, f1 INTO NAME metric VALUE {n})"""


@register("period_comparison", "WITH " + _HALF_SQL.format(n="early", cond="step < 360") + ","
          + _HALF_SQL.format(n="late", cond="step >= 360") + """
SELECT metric, round(early, 6) early, round(late, 6) late FROM early_l JOIN late_l USING (metric)""", ("p",))
def q_period_comparison(spark, sf):
    """Metrics of two evaluation sets side by side, joined on the
    metric name (first vs second half of the period)."""
    from ..operators import stats as D
    p = P(spark, sf)
    names = ["accuracy", "precision", "recall", "f1"]
    a = M.classification_metrics(p.where(F.col("step") < 360), 0.5).select(*names)
    b = M.classification_metrics(p.where(F.col("step") >= 360), 0.5).select(*names)
    s = D.side_by_side(a, b, "metric", names, "early", "late")
    return s.select("metric", r6("early").alias("early"), r6("late").alias("late"))


def _by_rounds(name, fn, sql, views):
    """The same query with quantiles and cut-offs found in rounds of narrowing
    windows, as on large tables, down to windows of seven values."""
    @register(f"{name}_by_rounds", sql, views)
    def run(spark, sf):
        with settling(7):
            return stored(fn(spark, sf), name)
    run.__doc__ = fn.__doc__


_by_rounds("stratified_split", q_stratified_split, _SPLIT_SQL, ("t",))
for _name in ("describe_by_class", "describe_customers", "temporal_split", "sample_rows"):
    _fn, _sql = REGISTRY[_name]
    _by_rounds(_name, _fn, _sql, ())
