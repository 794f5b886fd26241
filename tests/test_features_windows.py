"""Feature rules and the chunked running sum against a plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.features import build_cluster_features, build_fraud_features
from ledgerlens.operators.windows import exclusive_running_sum


def test_fraud_features_on_typical_fraud(spark):
    df = spark.createDataFrame([(1, "TRANSFER", 181.0, 181.0, 0.0, 0.0, 0.0)],
                               "step int, type string, amount double, oldbalanceOrg double, newbalanceOrig double,"
                               " oldbalanceDest double, newbalanceDest double")
    r = build_fraud_features(df).first()
    assert r["origin_balance_diff"] == 181.0 and r["origin_error"] == 0.0
    assert r["dest_error"] == -181.0 and r["is_transfer_or_cashout"] == 1
    assert r["is_zero_newbalance_origin"] == 1 and r["is_zero_oldbalance_dest"] == 1
    assert r["amount_to_oldbalance_ratio"] == 1.0 and r["step_bucket"] == 0


def test_step_bucket_floors_negative_steps(spark):
    df = spark.createDataFrame([(-1,), (23,), (24,)], "step int")
    assert [r["step_bucket"] for r in build_fraud_features(df).orderBy("step").collect()] == [-1, 0, 1]


def test_cluster_features(spark):
    df = spark.createDataFrame([(1980, "01/02/2014", 10, None, 0, 2, 1, 1, 0, 1, 1, 1, 1, 0, 1),
                                (1990, "bad", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)],
                               "Year_Birth int, Dt_Customer string, MntWines int, MntFruits int, "
                               "NumDealsPurchases int, NumWebPurchases int, Kidhome int, Teenhome int, "
                               "AcceptedCmp1 int, AcceptedCmp2 int, AcceptedCmp3 int, AcceptedCmp4 int, "
                               "AcceptedCmp5 int, Complain int, Response int")
    rows = {r["Year_Birth"]: r for r in build_cluster_features(df).collect()}
    a, b = rows[1980], rows[1990]
    assert a["Age"] == 46 and a["Total_Spending"] == 10 and a["Total_Purchases"] == 2
    assert a["Web_Ratio"] == 1.0 and a["Deals_Ratio"] == 0.0 and a["Children"] == 2
    assert a["Campaign_Acceptance_Total"] == 5 and a["Customer_Tenure_days"] == 0
    assert b["Customer_Tenure_days"] is None and b["Web_Ratio"] is None


def test_chunked_running_sum_matches_plain_window(spark):
    df = spark.range(0, 3000).select(
        (F.col("id") % 3).alias("key"), F.col("id").alias("t"), (F.col("id") % 17).cast("long").alias("v"))
    df = df.withColumn("chunk", F.floor(F.col("t") / 97))
    got = exclusive_running_sum(df, ["key"], "chunk", ["t"], "v", "run")
    w = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("run", F.coalesce(F.sum("v").over(w), F.lit(0)))
    diff = got.select("key", "t", "run").exceptAll(want.select("key", "t", "run"))
    assert got.count() == 3000 and diff.count() == 0
