"""Monitoring queries (I1-I10): gates, consistency, drift, alert volume,
segment checks, weekly quality and the A/B readout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binary_metrics as M
from ..operators import clustering as H
from ..operators import monitoring as I
from ..operators import sketches as K
from ..session import shared_path, stored
from ..sources.files import read_metrics, write_metrics
from ..sources.tables import read_table
from .catalog import P, T, X, r6, register
from .queries_customers import _SEG_SQL, engagement_segments
from ..operators.silhouette import silhouette
from .queries_models import _QUALITY_SQL, _SILHOUETTE_SQL, SILHOUETTE_MIN, labelings
from .queries_scoring import _BEST_SQL, _CUM, HASH_SQL
from ..operators import stats as D

#: The gate of the squared-distance silhouette (not the Euclidean one's 0.10).
SILHOUETTE_SQ_MIN = 0.20
REF_STEPS = 360  # reference window: step < 360; current window: the rest


@register("health_gates", "WITH " + _CUM + "," + _QUALITY_SQL + _SILHOUETTE_SQL + """
SELECT g.check, g.minimum, round(g.value, 6) value, coalesce(g.value >= g.minimum, false) passed FROM (
  SELECT 'fraud_pr_auc_min' "check", 0.9::DOUBLE minimum, (SELECT pr_auc FROM rk) value
  UNION ALL SELECT 'cluster_silhouette_min', 0.1::DOUBLE, (SELECT silhouette FROM esil WHERE model = 'label10')
  UNION ALL SELECT 'cluster_silhouette_sq_min', 0.2::DOUBLE, (SELECT silhouette_sq FROM q WHERE model = 'label10')) g""",
          ("p", "v"))
def q_health_gates(spark, sf):
    """PR-AUC >= 0.90, the Euclidean silhouette >= 0.10, and the
    squared-distance one against a limit of its own: where the Euclidean one is (b - a) / b = 0.10, the squared one
    is 1 - 0.9 ** 2 = 0.19; the gate takes 0.2."""
    pr = M.ranking_metrics(P(spark, sf)).select(F.lit("fraud_pr_auc_min").alias("check"), F.col("pr_auc").alias("value"))
    one = labelings(spark, sf).where(F.col("model") == "label10")
    cq = H.cluster_metrics(one, by=["model"])
    euclid = silhouette(one, "vec_id", by=["model"]).select(F.lit("cluster_silhouette_min").alias("check"), F.col("silhouette").alias("value"))
    sil = cq.select(F.lit("cluster_silhouette_sq_min").alias("check"), F.col("silhouette_sq").alias("value"))
    g = I.metric_gates(pr.unionByName(sil).unionByName(euclid),
                       {"fraud_pr_auc_min": 0.90, "cluster_silhouette_min": SILHOUETTE_MIN, "cluster_silhouette_sq_min": SILHOUETTE_SQ_MIN})
    return g.select("check", "minimum", r6("value").alias("value"), "passed")


@register("threshold_consistency", "WITH " + _BEST_SQL + """
SELECT o.output, round(o.threshold, 6) threshold, (SELECT threshold FROM bt) ref_threshold,
       abs(o.threshold - (SELECT threshold FROM bt)) <= 0.001 consistent
FROM (SELECT 'error_analysis' output, (SELECT threshold FROM bt) threshold
      UNION ALL SELECT 'cost_analysis', (SELECT threshold FROM bt) + 0.05) o""", ("p",))
def q_threshold_consistency(spark, sf):
    """I2 + A6 + A7: three metric tables are written (JSON and CSV) and read
    back; the threshold of the error and of the cost table must be the model
    comparison's. The cost table was made with a threshold moved by 0.05."""
    folder = metric_folder(spark)
    best = M.best_threshold(P(spark, sf), 0.75).first()["threshold"]
    write_metrics(spark.createDataFrame([("base", best)], "model string, threshold double"), f"{folder}/comparison", "json")
    write_metrics(M.error_summary(P(spark, sf), best), f"{folder}/error", "csv")
    write_metrics(M.cost_scenarios(P(spark, sf), [best + 0.05], best, 25.0), f"{folder}/cost", "csv")
    read = lambda name, kind: read_metrics(spark, f"{folder}/{name}", kind, "threshold double")
    t = I.threshold_consistency({"comparison": read("comparison", "json"), "error_analysis": read("error", "csv"), "cost_analysis": read("cost", "csv")}, "comparison")
    return t.withColumn("threshold", r6("threshold"))


@register("missing_outputs", "SELECT 'cost' AS name WHERE (SELECT count(*) FROM p) > 0", ("p",))
def q_missing_outputs(spark, sf):
    """Of three required outputs one was never written."""
    folder = metric_folder(spark)
    for name in ("comparison", "error"):
        write_metrics(M.error_summary(P(spark, sf), 0.5), f"{folder}/{name}", "json")
    return I.missing_artifacts(spark, folder, ["comparison", "error", "cost"])


# The numbers watched for drift.
PSI_COLUMNS = ["amount", "step", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def _psi_num_sql(col):
    return f"""
SELECT '{col}' feature, sum((q - p) * ln(q / p)) psi FROM (
  SELECT greatest(coalesce(p, 0), 1e-6) p, greatest(coalesce(q, 0), 1e-6) q FROM
  (SELECT b, count(*) / sum(count(*)) OVER () p FROM
     (SELECT len(list_filter((SELECT quantile_cont({col}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM t
                              WHERE step < {REF_STEPS}), lambda c: c < {col})) b FROM t WHERE step < {REF_STEPS}
      AND {col} IS NOT NULL) GROUP BY b) r
  FULL OUTER JOIN
  (SELECT b, count(*) / sum(count(*)) OVER () q FROM
     (SELECT len(list_filter((SELECT quantile_cont({col}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM t
                              WHERE step < {REF_STEPS}), lambda c: c < {col})) b FROM t WHERE step >= {REF_STEPS}
      AND {col} IS NOT NULL) GROUP BY b) c USING (b))"""


_PSI_CAT_SQL = f"""
SELECT 'type' feature, sum((q - p) * ln(q / p)) psi FROM (
  SELECT greatest(coalesce(p, 0), 1e-6) p, greatest(coalesce(q, 0), 1e-6) q FROM
  (SELECT "type" b, count(*) / sum(count(*)) OVER () p FROM t WHERE step < {REF_STEPS} GROUP BY 1) r
  FULL OUTER JOIN
  (SELECT "type" b, count(*) / sum(count(*)) OVER () q FROM t WHERE step >= {REF_STEPS} GROUP BY 1) c USING (b))"""


@register("psi_drift", "SELECT feature, round(psi, 6) psi, psi > 0.2 alert FROM ("
          + " UNION ALL ".join([*[_psi_num_sql(c) for c in PSI_COLUMNS], _PSI_CAT_SQL]) + ")", ("t",))
def q_psi_drift(spark, sf):
    """I4: population stability index, reference vs current window."""
    t = stored(T(spark, sf).select("type", *PSI_COLUMNS), "psi-input")
    ref, cur = t.where(F.col("step") < REF_STEPS), t.where(F.col("step") >= REF_STEPS)
    out = I.psi_numeric(ref, cur, PSI_COLUMNS).unionByName(I.psi_categorical(ref, cur, "type"))
    return out.select("feature", r6("psi").alias("psi"), (F.col("psi") > 0.2).alias("alert"))


@register("drift_rates", f"""
WITH v AS (
  SELECT 'purchase_rate' metric, (SELECT avg(CAST("type" = 'purchase' AS DOUBLE)) FROM t WHERE step < {REF_STEPS}) reference,
         (SELECT avg(CAST("type" = 'purchase' AS DOUBLE)) FROM t WHERE step >= {REF_STEPS}) current
  UNION ALL
  SELECT 'median_amount', (SELECT median(amount) FROM t WHERE step < {REF_STEPS}),
         (SELECT median(amount) FROM t WHERE step >= {REF_STEPS}))
SELECT metric, round(reference, 6) reference, round(current, 6) current,
       round((current - reference) / abs(reference), 6) relative_change,
       abs((current - reference) / abs(reference)) > 0.2 alert FROM v""", ("t",))
def q_drift_rates(spark, sf):
    """Relative change of the risky-type rate and the median amount."""
    t = X(spark, sf)
    ref, cur = t.where(F.col("step") < REF_STEPS), t.where(F.col("step") >= REF_STEPS)
    d = I.relative_drift(ref, cur, {"purchase_rate": ("rate", F.col("type") == "purchase"),
                                    "median_amount": ("median", "amount")})
    return d.select("metric", *[r6(c).alias(c) for c in ("reference", "current", "relative_change")], "alert")


@register("alerts_per_day", """
SELECT CAST(floor(step / 24) AS INT) "day", count_if(proba >= 0.67) alerts, count(*) "rows",
       count_if(proba >= 0.67) > 60 over_capacity FROM p GROUP BY 1""", ("p",))
def q_alerts_per_day(spark, sf):
    """I6 (batch form): alerts per day against a capacity of 60 reviews."""
    p = P(spark, sf)
    return I.alerts_per_day(p, F.floor(F.col("step") / 24).cast("int"), F.col("proba") >= 0.67, 60)


@register("small_segments", "WITH " + _SEG_SQL + """
SELECT cluster, round(cluster_size / sum(cluster_size) OVER (), 6) share,
       cluster_size / sum(cluster_size) OVER () < 0.02 too_small FROM prof""", ("s",))
def q_small_segments(spark, sf):
    """Segments holding less than 2 % of the customers."""
    sh = D.segment_shares(D.profile_clusters(engagement_segments(spark, sf)))
    return I.small_clusters(sh).select("cluster", r6("share").alias("share"), "too_small")


_MIG_SQL = f"""
c AS (SELECT nameOrig, "type", step < {REF_STEPS} is_ref, count(*) n FROM t GROUP BY 1, 2, 3),
d AS (SELECT nameOrig, is_ref, arg_min("type", (-n, "type")) seg FROM c GROUP BY 1, 2),
j AS (SELECT o.nameOrig, o.seg "old", n.seg "new" FROM d o JOIN d n ON o.nameOrig = n.nameOrig
      WHERE o.is_ref AND NOT n.is_ref)"""


def metric_folder(spark):
    """A folder of its own for a query's metric tables."""
    import uuid
    return shared_path(spark, "metrics", uuid.uuid4().hex)


def _migration(spark, sf):
    t = X(spark, sf)
    old = I.dominant_value(t.where(F.col("step") < REF_STEPS), "nameOrig", "type", "old")
    new = I.dominant_value(t.where(F.col("step") >= REF_STEPS), "nameOrig", "type", "new")
    return I.migration(old, new, "nameOrig")


@register("segment_migration", "WITH " + _MIG_SQL + """
SELECT "old", "new", count(*) n FROM j GROUP BY 1, 2""", ("t",))
def q_segment_migration(spark, sf):
    """I8: users' dominant activity in the reference vs current window."""
    return _migration(spark, sf)[0]


@register("segment_migration_rate", "WITH " + _MIG_SQL + """
SELECT round(avg(CAST("old" <> "new" AS DOUBLE)), 6) migration_rate, count(*) keys,
       avg(CAST("old" <> "new" AS DOUBLE)) > 0.2 alert FROM j""", ("t",))
def q_segment_migration_rate(spark, sf):
    """I8: share of users whose segment changed (> 20 % alerts)."""
    r = _migration(spark, sf)[1]
    return r.select(r6("migration_rate").alias("migration_rate"), "keys", "alert")


@register("weekly_quality", "WITH " + _CUM + """,
wk AS (SELECT CAST(floor(step / 168) AS INT) "week", * FROM p),
sc2 AS (SELECT "week", proba score, count_if(y = 1) pos, count_if(y <> 1) neg FROM wk GROUP BY 1, 2),
cum2 AS (SELECT *, sum(pos) OVER (PARTITION BY "week" ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tp,
                sum(neg) OVER (PARTITION BY "week" ORDER BY score DESC ROWS UNBOUNDED PRECEDING) fp FROM sc2),
ap AS (SELECT "week", sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) pr_auc FROM cum2 GROUP BY 1),
cf AS (SELECT "week", count_if(y = 1 AND proba >= 0.5) tp, count_if(y <> 1 AND proba >= 0.5) fp,
              count_if(y = 1 AND proba < 0.5) fn FROM wk GROUP BY 1)
SELECT "week", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)
       "precision", round(pr_auc, 6) pr_auc, pr_auc < (SELECT pr_auc FROM rk) * 0.95 pr_auc_alert,
       coalesce(tp / nullif(tp + fn, 0), 0) < 0.9 recall_alert, coalesce(tp / nullif(tp + fp, 0), 0) < 0.95 precision_alert
FROM cf JOIN ap USING ("week")""", ("p",))
def q_weekly_quality(spark, sf):
    """Weekly recall / precision / PR-AUC against the overall PR-AUC."""
    p = P(spark, sf)
    base = M.ranking_metrics(p).select("pr_auc").scalar()
    w = I.weekly_quality(p, F.floor(F.col("step") / 168).cast("int"), 0.5, base)
    return w.select("week", *[r6(c).alias(c) for c in ("recall", "precision", "pr_auc")], "pr_auc_alert", "recall_alert", "precision_alert")


@register("ab_readout", f"""
WITH g AS (SELECT c_custkey cust, CASE WHEN {HASH_SQL.format(k="c_custkey")} % 2 = 0 THEN 'B' ELSE 'A' END grp
           FROM customer),
o AS (SELECT o_custkey cust, o_orderkey, o_orderdate, o_totalprice,
             lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) nxt FROM orders),
w AS (SELECT *, o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 28 DAY in_win FROM o),
pc AS (SELECT cust, max(CAST(in_win AS INT)) converted,
              sum(CASE WHEN in_win THEN CAST(o_totalprice AS DECIMAL(18,2)) END) win_sum, count_if(in_win) win_n,
              count_if(nxt IS NOT NULL AND nxt <= o_orderdate + INTERVAL 30 DAY) rep_n, count(*) orders
       FROM w GROUP BY 1)
SELECT grp, count(*) customers, round(avg(CAST(coalesce(converted, 0) AS DOUBLE)), 6) conversion,
       round(CAST(sum(win_sum) / sum(win_n) AS DOUBLE), 6) basket, round(sum(rep_n) / sum(orders), 6) repurchase_30d
FROM g LEFT JOIN pc USING (cust) GROUP BY grp""")
def q_ab_readout(spark, sf):
    """A/B campaign readout over the customers and their orders."""
    orders = read_table(spark, sf, "orders")
    start = orders.agg(F.max("o_orderdate")).scalar() - F.expr("INTERVAL 28 DAYS")
    r = I.ab_readout(read_table(spark, sf, "customer"), orders, start)
    return r.select("grp", "customers", *[r6(c).alias(c) for c in ("conversion", "basket", "repurchase_30d")])


@register("alerts_per_day_stream", """
SELECT date_trunc('day', ts) "day",
       count_if(floor(least(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), 499.99) / 5) / 100 >= 0.67) alerts,
       count(*) "rows",
       count_if(floor(least(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), 499.99) / 5) / 100 >= 0.67) > 60
         over_capacity
FROM events GROUP BY 1""")
def q_alerts_per_day_stream(spark, sf):
    """I6 as Structured Streaming: the events folder is read as a file
    stream, scored, and counted per one-day tumbling window (availableNow)."""
    import hashlib
    import uuid

    from ..streaming.alerts import daily_alert_stream
    run = f"daily_alerts_{hashlib.md5(sf.encode()).hexdigest()[:8]}_{uuid.uuid4().hex[:8]}"
    return daily_alert_stream(spark, sf, 0.67, 60, run, pattern="events.parquet")


@register("alerts_closed_days_stream", """
WITH d AS (SELECT date_trunc('day', ts) "day", floor(least(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), 499.99) / 5) / 100 >= 0.67 alert
           FROM (SELECT DISTINCT event_id, ts, value FROM events))
SELECT "day", count_if(alert) alerts, count(*) "rows", count_if(alert) > 60 over_capacity FROM d
WHERE "day" + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""")
def q_alerts_closed_days_stream(spark, sf):
    """I6 as an append-mode stream: days that the watermark, a day behind the
    last event, has closed, with each event counted once."""
    import uuid

    from ..streaming.alerts import closed_day_stream
    return closed_day_stream(spark, sf, 0.67, 60, f"closed_days_{uuid.uuid4().hex}", pattern="events.parquet")


# -- from stored summaries: every day is read once, and checks merge days ------

def _day_summaries(spark, sf):
    """The folder of the days' sketches, category counts and score bins."""
    folder = shared_path(spark, "sketches", f"{abs(hash(sf))}-{metric_folder(spark).rsplit('/', 1)[1]}")
    day = F.floor(F.col("step") / 24)
    K.save_days(T(spark, sf).select("type", *PSI_COLUMNS), folder, day, PSI_COLUMNS, ["type"])
    return folder


def _windows():
    """The days of the reference window and of the current one."""
    return F.col("day") < REF_STEPS // 24, F.col("day") >= REF_STEPS // 24


@register("psi_from_sketches", "SELECT feature, round(psi, 6) psi, 0.0::DOUBLE psi_error, psi > 0.2 alert FROM ("
          + " UNION ALL ".join([*[_psi_num_sql(c).replace("quantile_cont", "quantile_disc") for c in PSI_COLUMNS], _PSI_CAT_SQL]) + ")", ("t",))
def q_psi_from_sketches(spark, sf):
    """I4 from stored daily sketches: bins at values that occur (the reference
    sketch's deciles). Windows of up to 8,192 values are exact; beyond that
    ``psi_error`` bounds the index."""
    p = K.psi_from_sketches(spark, _day_summaries(spark, sf), *_windows())
    return p.select("feature", r6("psi").alias("psi"), "psi_error", "alert")


@register("drift_from_sketches", f"""
WITH v AS (
  SELECT 'purchase_rate' metric, (SELECT avg(CAST("type" = 'purchase' AS DOUBLE)) FROM t WHERE step < {REF_STEPS}) reference,
         (SELECT avg(CAST("type" = 'purchase' AS DOUBLE)) FROM t WHERE step >= {REF_STEPS}) current
  UNION ALL
  SELECT 'median_amount', (SELECT quantile_disc(amount, 0.5) FROM t WHERE step < {REF_STEPS}),
         (SELECT quantile_disc(amount, 0.5) FROM t WHERE step >= {REF_STEPS}))
SELECT metric, round(reference, 6) reference, round(current, 6) current, round((current - reference) / abs(reference), 6) relative_change,
       abs((current - reference) / abs(reference)) > 0.2 alert FROM v""", ("t",))
def q_drift_from_sketches(spark, sf):
    """I5 from stored daily summaries: the risky type's share and the lower
    median of the amount."""
    d = K.drift_from_sketches(spark, _day_summaries(spark, sf), *_windows(), {"purchase_rate": ("type", "purchase")}, {"median_amount": "amount"})
    return d.select("metric", *[r6(c).alias(c) for c in ("reference", "current", "relative_change")], "alert")


@register("weekly_quality_from_sketches", "WITH " + _CUM + """,
wk AS (SELECT CAST(floor(floor(step / 24) / 7) AS INT) "week", * FROM p),
sc2 AS (SELECT "week", proba score, count_if(y = 1) pos, count_if(y <> 1) neg FROM wk GROUP BY 1, 2),
cum2 AS (SELECT *, sum(pos) OVER (PARTITION BY "week" ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tp,
                sum(neg) OVER (PARTITION BY "week" ORDER BY score DESC ROWS UNBOUNDED PRECEDING) fp FROM sc2),
ap AS (SELECT "week", sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) pr_auc FROM cum2 GROUP BY 1),
cf AS (SELECT "week", count_if(y = 1 AND proba >= 0.5) tp, count_if(y <> 1 AND proba >= 0.5) fp,
              count_if(y = 1 AND proba < 0.5) fn FROM wk GROUP BY 1)
SELECT "week", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision",
       round(pr_auc, 6) pr_auc, true within_bounds, pr_auc < (SELECT pr_auc FROM rk) * 0.95 pr_auc_alert FROM cf JOIN ap USING ("week")""", ("p",))
def q_weekly_quality_from_sketches(spark, sf):
    """I9 from stored daily score bins: weekly recall, precision and average
    precision against that of all days. The scores have 100 levels, fewer than
    the bins, so the numbers are exact; the bounds hold for any scores."""
    folder = shared_path(spark, "sketches", metric_folder(spark).rsplit("/", 1)[1])
    K.save_days(P(spark, sf), folder, F.floor(F.col("step") / 24), score="proba", label="y")
    base = K.quality_from_sketches(spark, folder, F.lit(0), 0.5).select("pr_auc").scalar()
    w = K.quality_from_sketches(spark, folder, F.floor(F.col("day") / 7).cast("int"), 0.5, base)
    inside = (F.col("pr_auc_low") <= F.col("pr_auc")) & (F.col("pr_auc") <= F.col("pr_auc_high"))
    return w.select(F.col("period").alias("week"), *[r6(c).alias(c) for c in ("recall", "precision", "pr_auc")],
                    F.coalesce(inside, F.lit(True)).alias("within_bounds"), "pr_auc_alert")
