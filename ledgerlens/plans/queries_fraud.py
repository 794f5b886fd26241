"""Fraud-side queries: cleaning, features, exploratory aggregates (views T
and P). Each registration pairs the Spark plan with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as B
from ..operators import features as C
from ..operators import stats as D
from .catalog import X, T, r6, register

TX_COLS = ["step", "type", "amount", "nameOrig", "nameDest", "isFraud", "oldbalanceOrg",
           "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


# The fixture's stand-ins for the risky transaction types.
RISK_TYPES = ("purchase", "error")


def clean_tx(spark, sf):
    """B2 over the transactions, keyed by event id."""
    return B.preprocess_fraud(T(spark, sf), unique="event_id")


def feature_tx(spark, sf):
    return C.build_fraud_features(clean_tx(spark, sf), RISK_TYPES)


# -- T itself --------------------------------------------------------------

@register("transactions_view", "SELECT * FROM t", ("t",))
def q_transactions_view(spark, sf):
    return T(spark, sf)


# -- B ---------------------------------------------------------------------

@register("clean_transactions", """
SELECT DISTINCT step, "type", amount, nameOrig, nameDest, isFraud, nullif(oldbalanceOrg, 0) oldbalanceOrg,
       newbalanceOrig, oldbalanceDest, newbalanceDest FROM t""", ("t",))
def q_clean_transactions(spark, sf):
    # without the event id the projection has repeated rows: B1 removes them
    return B.preprocess_fraud(T(spark, sf).select(*TX_COLS))


@register("balance_inconsistency", """
SELECT round(avg(CASE WHEN (oldbalanceOrg - amount) IS NOT DISTINCT FROM newbalanceOrig THEN 0.0 ELSE 1.0 END), 6)
         origin_inconsistency,
       round(avg(CASE WHEN (oldbalanceDest + amount) IS NOT DISTINCT FROM newbalanceDest THEN 0.0 ELSE 1.0 END), 6)
         dest_inconsistency
FROM t""", ("t",))
def q_balance_inconsistency(spark, sf):
    out = B.balance_inconsistency(T(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


_MISSING_COLS = ["event_id"] + TX_COLS


@register("missing_profile", """
SELECT "column", missing FROM (
  UNPIVOT (SELECT {counts} FROM (SELECT event_id, step, "type", amount, nameOrig, nameDest, isFraud,
                  nullif(oldbalanceOrg, 0) oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest FROM t))
  ON {cols} INTO NAME "column" VALUE missing)
ORDER BY missing DESC, "column" LIMIT 10""".format(
    counts=", ".join(f'count_if("{c}" IS NULL) "{c}"' for c in _MISSING_COLS),
    cols=", ".join(f'"{c}"' for c in _MISSING_COLS)), ("t",))
def q_missing_profile(spark, sf):
    return B.missing_profile(clean_tx(spark, sf).select(*_MISSING_COLS))


@register("duplicate_count", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) duplicates FROM (
  SELECT count(*) n FROM t GROUP BY step, "type", amount, nameOrig, nameDest, isFraud, oldbalanceOrg,
     newbalanceOrig, oldbalanceDest, newbalanceDest)""", ("t",))
def q_duplicate_count(spark, sf):
    return B.duplicate_count(T(spark, sf).select(*TX_COLS))


@register("class_labels", """
SELECT CASE WHEN isFraud = 1 THEN 'Fraude' ELSE 'Normal' END label, count(*) n FROM t GROUP BY 1""", ("t",))
def q_class_labels(spark, sf):
    return B.label_class(X(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("feature_drop_align", """
SELECT event_id, step, "type", amount, nullif(oldbalanceOrg, 0) oldbalanceOrg, newbalanceOrig, oldbalanceDest,
       newbalanceDest, CAST(NULL AS DOUBLE) isFlaggedFraud
FROM t""", ("t",))
def q_feature_drop_align(spark, sf):
    """B5 + B6: drop ids/target, then align to a training column list that
    holds a column the input lacks (``isFlaggedFraud``)."""
    from pyspark.sql import types as Ty
    x = B.drop_feature_columns(clean_tx(spark, sf), ["nameOrig", "nameDest", "isFlaggedFraud", "isFraud"])
    schema = Ty.StructType([Ty.StructField("event_id", Ty.LongType()), Ty.StructField("step", Ty.IntegerType()),
                            Ty.StructField("type", Ty.StringType())]
                           + [Ty.StructField(c, Ty.DoubleType()) for c in
                              ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
                               "isFlaggedFraud"]])
    return B.align_to_columns(x, schema)


# -- C ---------------------------------------------------------------------

_FEATURES_SQL = """
SELECT *, origin_balance_diff - amount origin_error, dest_balance_diff - amount dest_error FROM (
SELECT event_id, step, "type", amount, nameOrig, nameDest, isFraud, ob oldbalanceOrg, newbalanceOrig,
       oldbalanceDest, newbalanceDest,
       ob - newbalanceOrig origin_balance_diff,
       newbalanceDest - oldbalanceDest dest_balance_diff,
       CAST(coalesce("type" IN ('purchase', 'error'), false) AS INT) is_transfer_or_cashout,
       CAST(coalesce(newbalanceOrig = 0, false) AS INT) is_zero_newbalance_origin,
       CAST(coalesce(oldbalanceDest = 0, false) AS INT) is_zero_oldbalance_dest,
       amount / nullif(ob, 0) amount_to_oldbalance_ratio,
       CAST(floor(step / 24) AS INT) step_bucket
FROM (SELECT *, nullif(oldbalanceOrg, 0) ob FROM t))"""


@register("fraud_features", f"""
SELECT * EXCLUDE (origin_balance_diff, dest_balance_diff), origin_balance_diff, dest_balance_diff,
       round(log10(greatest(amount, 1.0)), 6) amount_log10, round(ln(1 + amount), 6) amount_log1p,
       abs(origin_error) abs_origin_error, abs(dest_error) abs_dest_error
FROM ({_FEATURES_SQL})""", ("t",))
def q_fraud_features(spark, sf):
    f = C.add_amount_transforms(feature_tx(spark, sf))
    return f.withColumn("amount_log10", r6("amount_log10")).withColumn("amount_log1p", r6("amount_log1p"))


# -- D ---------------------------------------------------------------------

@register("fraud_by_type", """
SELECT "type", count(*) n, CAST(sum(isFraud) AS BIGINT) frauds, round(avg(isFraud), 6) fraud_rate
FROM t GROUP BY "type" """, ("t",))
def q_fraud_by_type(spark, sf):
    return D.fraud_by_type(X(spark, sf)).withColumn("fraud_rate", r6("fraud_rate"))


@register("fraud_type_summary", """
SELECT "type", count(*) transactions, CAST(sum(isFraud) AS BIGINT) frauds, round(avg(amount), 6) avg_amount,
       round(median(amount), 6) median_amount, round(sum(isFraud) / count(*), 6) fraud_rate
FROM t GROUP BY "type" """, ("t",))
def q_fraud_type_summary(spark, sf):
    d = D.fraud_type_summary(X(spark, sf))
    return d.select("type", "transactions", "frauds", r6("avg_amount").alias("avg_amount"),
                    r6("median_amount").alias("median_amount"), r6("fraud_rate").alias("fraud_rate"))


@register("fraud_type_sums", """
SELECT "type", count(*) transactions, CAST(sum(isFraud) AS BIGINT) frauds,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) amount_sum,
       round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) amount_mean,
       round(sum(isFraud) / count(*), 6) fraud_rate
FROM t GROUP BY "type" """, ("t",))
def q_fraud_type_sums(spark, sf):
    d = D.fraud_type_sums(X(spark, sf))
    return d.withColumn("amount_mean", r6("amount_mean")).withColumn("fraud_rate", r6("fraud_rate"))


@register("class_summary", """
SELECT isFraud, transactions, label, round(transactions / sum(transactions) OVER (), 6) share FROM (
  SELECT CAST(isFraud AS INT) isFraud, count(*) transactions,
         CASE WHEN isFraud = 1 THEN 'Fraude' ELSE 'Normal' END label
  FROM t GROUP BY isFraud)""", ("t",))
def q_class_summary(spark, sf):
    return D.class_summary(X(spark, sf)).withColumn("share", r6("share"))


@register("positive_rate", """
SELECT round(avg(isFraud), 6) positive_rate, count(*) "rows" FROM t""", ("t",))
def q_positive_rate(spark, sf):
    return D.positive_rate(X(spark, sf)).withColumn("positive_rate", r6("positive_rate"))


@register("fraud_time_summary", """
SELECT CAST(floor(step / 24) AS INT) step_bucket, count(*) transactions, CAST(sum(isFraud) AS BIGINT) frauds,
       round(avg(amount), 6) amount, round(sum(isFraud) / count(*), 6) fraud_rate
FROM t GROUP BY 1""", ("t",))
def q_fraud_time_summary(spark, sf):
    d = D.time_bucket_summary(X(spark, sf))
    return d.withColumn("amount", r6("amount")).withColumn("fraud_rate", r6("fraud_rate"))


@register("frauds_per_step", """
SELECT step, CAST(sum(isFraud) AS BIGINT) n_fraudes FROM t GROUP BY step""", ("t",))
def q_frauds_per_step(spark, sf):
    return D.frauds_per_step(X(spark, sf))


@register("balance_diagnostics", f"""
SELECT CASE WHEN isFraud = 1 THEN 'Fraude' ELSE 'Normal' END label,
       round(avg(is_zero_newbalance_origin), 6) zero_newbalance_origin_rate,
       round(avg(is_zero_oldbalance_dest), 6) zero_oldbalance_dest_rate,
       round(median(amount), 6) median_amount,
       round(median(abs(origin_error)), 6) abs_origin_error,
       round(median(abs(dest_error)), 6) abs_dest_error
FROM ({_FEATURES_SQL}) GROUP BY 1""", ("t",))
def q_balance_diagnostics(spark, sf):
    d = D.balance_diagnostics(B.label_class(feature_tx(spark, sf)))
    return d.select("label", *[r6(c).alias(c) for c in d.columns if c != "label"])


_DESCRIBE_COLS = ["amount", "origin_error", "dest_error"]


@register("describe_by_class", """
WITH x AS (SELECT isFraud, oldbalanceOrg - newbalanceOrig - amount origin_error,
                  newbalanceDest - oldbalanceDest - amount dest_error, amount FROM t),
l AS (UNPIVOT x ON amount, origin_error, dest_error INTO NAME "column" VALUE v)
SELECT isFraud, "column", count(v) "count", round(avg(v), 6) mean, round(stddev_samp(v), 6) std,
       min(v) "min", max(v) "max", round(quantile_cont(v, 0.25), 6) q25, round(quantile_cont(v, 0.5), 6) q50,
       round(quantile_cont(v, 0.75), 6) q75
FROM l GROUP BY isFraud, "column" """, ("t",))
def q_describe_by_class(spark, sf):
    t = T(spark, sf)
    x = t.select("isFraud", "amount",
                 (F.col("oldbalanceOrg") - F.col("newbalanceOrig") - F.col("amount")).alias("origin_error"),
                 (F.col("newbalanceDest") - F.col("oldbalanceDest") - F.col("amount")).alias("dest_error"))
    d = D.describe(x, _DESCRIBE_COLS, ["isFraud"])
    return d.select("isFraud", "column", "count", "min", "max",
                    *[r6(c).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@register("amount_histogram", """
WITH b AS (SELECT min(amount) lo, max(amount) hi FROM t),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((amount - lo) / ((hi - lo) / 100)), 99) END AS INT) bin,
             count(*) "count", any_value(lo) lo, any_value(hi) hi
      FROM t, b WHERE amount IS NOT NULL GROUP BY 1)
SELECT bin, "count", round(lo + bin * ((hi - lo) / 100), 6) bin_start,
       round(lo + (bin + 1) * ((hi - lo) / 100), 6) bin_end FROM h""", ("t",))
def q_amount_histogram(spark, sf):
    h = D.histogram(X(spark, sf), "amount", 100)
    return h.withColumn("bin_start", r6("bin_start")).withColumn("bin_end", r6("bin_end"))


@register("box_log_amount", """
WITH x AS (SELECT "type", CASE WHEN isFraud = 1 THEN 'Fraude' ELSE 'Normal' END label,
                  round(log10(greatest(amount, 1.0)), 9) amount_log FROM t)
SELECT "type", label, min(amount_log) "min", max(amount_log) "max", count(amount_log) n,
       round(quantile_cont(amount_log, 0.25), 6) q1, round(quantile_cont(amount_log, 0.5), 6) median,
       round(quantile_cont(amount_log, 0.75), 6) q3
FROM x GROUP BY 1, 2""", ("t",))
def q_box_log_amount(spark, sf):
    x = B.label_class(X(spark, sf)).select(
        "type", "label", F.round(F.log10(F.greatest(F.col("amount"), F.lit(1.0))), 9).alias("amount_log"))
    b = D.box_stats(x, "amount_log", ["type", "label"])
    return b.select("type", "label", "min", "max", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3")])


_CORR_COLS = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "isFraud"]


def _corr_sql():
    pairs = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i:]:
            sel = f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            pairs.append(f"SELECT '{a}' col_a, '{b}' col_b, {sel} corr FROM t")
            if a != b:
                pairs.append(f"SELECT '{b}' col_a, '{a}' col_b, {sel} corr FROM t")
    return "\nUNION ALL ".join(pairs)


@register("correlation_matrix", _corr_sql(), ("t",))
def q_correlation_matrix(spark, sf):
    c = D.correlation_matrix(T(spark, sf), _CORR_COLS)
    return c.withColumn("corr", r6("corr"))


@register("top_types", """
SELECT "type", count(*) "count" FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""", ("t",))
def q_top_types(spark, sf):
    return D.top_values(X(spark, sf), "type", 3)


@register("suspicious_examples", f"""
SELECT event_id, step, "type", amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud,
       origin_error, dest_error, amount_to_oldbalance_ratio, abs(origin_error) abs_origin_error
FROM ({_FEATURES_SQL})
ORDER BY isFraud DESC, amount DESC, abs(origin_error) DESC NULLS LAST, event_id LIMIT 12""", ("t",))
def q_suspicious_examples(spark, sf):
    return D.suspicious_examples(feature_tx(spark, sf), 12)


@register("metrics_long", """
SELECT "type", variable, round(value, 6) value FROM (
  UNPIVOT (SELECT "type", avg(amount) avg_amount, avg(isFraud) fraud_rate, avg(step) avg_step FROM t GROUP BY 1)
  ON avg_amount, fraud_rate, avg_step INTO NAME variable VALUE value)""", ("t",))
def q_metrics_long(spark, sf):
    """Per-type metrics melted to (type, variable, value)."""
    wide = X(spark, sf).groupBy("type").agg(F.avg("amount").alias("avg_amount"),
                                            F.avg("isFraud").alias("fraud_rate"), F.avg("step").alias("avg_step"))
    return D.melt(wide, ["type"], ["avg_amount", "fraud_rate", "avg_step"]).withColumn("value", r6("value"))


@register("preferred_type_order", """
SELECT "type", n, CAST(row_number() OVER (ORDER BY CASE "type" WHEN 'purchase' THEN 1 WHEN 'error' THEN 2
       ELSE 3 END, "type") AS INT) position
FROM (SELECT "type", count(*) n FROM t GROUP BY 1)""", ("t",))
def q_preferred_type_order(spark, sf):
    """Known names first (purchase, error), then the rest by name; the
    position is materialised so the order survives an unordered compare."""
    from pyspark.sql import Window
    counts = X(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the handful of aggregated rows only
    return counts.withColumn("position", F.row_number().over(Window.orderBy(*D.preferred_position("type", ["purchase", "error"]))).cast("int"))

