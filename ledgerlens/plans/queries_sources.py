"""Source and sink queries (A1-A4) and listings (B13-B15, D25, D13 for customers)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import binary_metrics as M
from ..operators import cleaning as B
from ..operators import sampling as E
from ..operators import stats as D
from ..session import shared_path
from ..sources import files as A
from .catalog import P, S, T, X, r6, register
from .queries_customers import _FEAT_SQL, prepared_customers
from .queries_scoring import CURVE, HASH_SQL, _grid_sql


def _written(spark, df, name):
    path = shared_path(spark, "csv", f"{name}-{uuid.uuid4().hex}")
    A.write_csv(df, path)
    return path


@register("transactions_csv", """
SELECT step, "type", amount, CAST(nameOrig AS VARCHAR) nameOrig, oldbalanceOrg, newbalanceOrig, CAST(nameDest AS VARCHAR) nameDest,
       oldbalanceDest, newbalanceDest, isFraud, CAST(NULL AS INT) isFlaggedFraud FROM t""", ("t",))
def q_transactions_csv(spark, sf):
    """A1: the transactions written as a ``;`` CSV and read with the declared
    schema; a column that the file lacks is null."""
    return A.load_transactions(spark, _written(spark, T(spark, sf).drop("event_id"), "transactions"))


_CUSTOMER_COLUMNS = [c.split()[0] for c in A.CUSTOMER_SCHEMA.split(", ")]


@register("customers_csv", "SELECT {} FROM s".format(", ".join(_CUSTOMER_COLUMNS)), ("s",))
def q_customers_csv(spark, sf):
    """A2: the customers through a ``;`` CSV; the file's column order differs
    from the schema's."""
    return A.load_customers(spark, _written(spark, S(spark, sf), "customers"))


@register("absent_csv_rows", "SELECT 0 AS \"rows\", count(*) AS present FROM s", ("s",))
def q_absent_csv_rows(spark, sf):
    """A3 + A4: a path that is not there gives no rows, beside one that is."""
    path = _written(spark, S(spark, sf), "customers")
    none = A.row_count(A.read_or_empty(spark, path + "-absent", A.CUSTOMER_SCHEMA))
    return none.crossJoin(F.broadcast(A.row_count(A.read_or_empty(spark, path, A.CUSTOMER_SCHEMA)).withColumnRenamed("rows", "present")))


@register("feature_labels", """
SELECT name, CASE name WHEN 'num__amount' THEN 'Amount' WHEN 'cat__type_purchase' THEN 'type=purchase' ELSE replace(name, 'num__', '') END label
FROM (SELECT 'num__amount' AS name UNION ALL SELECT DISTINCT 'cat__type_' || "type" FROM t WHERE "type" = 'purchase' UNION ALL SELECT 'num__step_bucket')""", ("t",))
def q_feature_labels(spark, sf):
    """Encoded feature names to labels."""
    types = X(spark, sf).where("type = 'purchase'").select(F.concat(F.lit("cat__type_"), F.col("type")).alias("name")).distinct()
    names = types.union(spark.createDataFrame([("num__amount",), ("num__step_bucket",)], "name string"))
    return names.select("name", B.label_feature("name").alias("label"))


@register("model_keys", """
SELECT DISTINCT 'kmeans_k' || (nameDest % 10) AS "key", 'kmeans' AS family, CAST(nameDest % 10 AS INT) k FROM t""", ("t",))
def q_model_keys(spark, sf):
    """Model keys taken apart."""
    keys = X(spark, sf).select(F.concat(F.lit("kmeans_k"), F.col("nameDest") % 10).alias("key")).distinct()
    family, k = B.parse_model_key("key")
    return keys.select("key", family.alias("family"), k.alias("k"))


_PROFILE = ["event_id", "step", "type", "amount", "nameOrig", "nameDest", "isFraud"]


@register("frame_profile", """
SELECT CAST(i AS INT) position, c "column", (SELECT count(*) FROM t) "rows", CAST({n} AS INT) "columns" FROM (VALUES {v}) f(i, c)""".format(
    n=len(_PROFILE), v=", ".join(f"({i}, '{c}')" for i, c in enumerate(_PROFILE))), ("t",))
def q_frame_profile(spark, sf):
    """Rows, columns and their order (the types' names differ between engines)."""
    return B.frame_profile(X(spark, sf)).drop("dtype")


@register("nearest_threshold", f"""
WITH c AS (SELECT threshold, count_if(y = 1 AND proba >= threshold) + count_if(y <> 1 AND proba >= threshold) alerts
           FROM p, {_grid_sql(CURVE)} GROUP BY threshold)
SELECT threshold, alerts FROM c ORDER BY abs(threshold - 0.67), threshold LIMIT 1""", ("p",))
def q_nearest_threshold(spark, sf):
    """The curve's row nearest to a threshold."""
    return D.nearest_row(M.threshold_sweep(P(spark, sf), CURVE).select("threshold", "alerts"), "threshold", 0.67)


_CUSTOMER_SETS = ["Income", "Recency", "Total_Spending", "Total_Purchases", "Age", "Children", "Campaign_Acceptance_Total",
                  "NumWebPurchases", "NumStorePurchases", "NumDealsPurchases"]


def _pairs_sql():
    return "\nUNION ALL ".join(f"SELECT '{a}' col_a, '{b}' col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) corr FROM sf2"
                               for a in _CUSTOMER_SETS for b in _CUSTOMER_SETS)


@register("customer_correlations", "WITH " + _FEAT_SQL + " " + _pairs_sql(), ("s",))
def q_customer_correlations(spark, sf):
    """D13 for ten customer columns."""
    return D.correlation_matrix(prepared_customers(spark, sf), _CUSTOMER_SETS).withColumn("corr", r6("corr"))


@register("hashed_split", f"""
WITH u AS (SELECT event_id, {HASH_SQL.format(k="event_id")} / 4503599627370496.0 u FROM t)
SELECT CASE WHEN u < 0.15 THEN 'test' WHEN u < {0.15 + 0.85 * 0.1765!r} THEN 'val' ELSE 'train' END split, count(*) "rows" FROM u GROUP BY 1""", ("t",))
def q_hashed_split(spark, sf):
    """E2 without exact sizes: a hash threshold a row, no shuffle to split."""
    s = E.hashed_split(X(spark, sf).select("event_id"), "event_id")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
