"""Reference unit cases for the two preprocessing steps, plus cleaning ops."""

from pyspark.sql import types as T

from ledgerlens.operators import cleaning as B


def test_preprocess_cluster_fills_median_and_drops_constants(spark):
    df = spark.createDataFrame([(1000.0, 3, 11), (None, 3, 11), (2000.0, 3, 11)],
                               "Income double, Z_CostContact int, Z_Revenue int")
    out = B.preprocess_cluster(df)
    assert "Z_CostContact" not in out.columns and "Z_Revenue" not in out.columns
    incomes = sorted(r["Income"] for r in out.collect())
    assert incomes == [1000.0, 1500.0, 2000.0]


def test_preprocess_fraud_zero_origin_balance_becomes_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (100.0, 20.0, 80.0)],
                               "oldbalanceOrg double, newbalanceOrig double, amount double")
    rows = {r["amount"]: r["oldbalanceOrg"] for r in B.preprocess_fraud(df).collect()}
    assert rows[10.0] is None and rows[80.0] == 100.0


def test_basic_cleaning_trims_names_and_drops_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "` x ` int, `y ` string")
    out = B.basic_cleaning(df)
    assert out.columns == ["x", "y"] and out.count() == 2


def test_align_to_columns_fills_missing_and_drops_extra(spark):
    df = spark.createDataFrame([(1, 2.0, "z")], "a int, b double, extra string")
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    out = B.align_to_columns(df, schema)
    assert out.columns == ["b", "c"] and out.first()["c"] is None


def test_segments_default_for_unknown_cluster(spark):
    df = spark.createDataFrame([(0,), (7,)], "cluster int")
    rows = {r["cluster"]: r["segment"] for r in B.attach_segments(df).collect()}
    assert rows[0] == B.SEGMENT_NAMES[0] and rows[7] == B.SEGMENT_DEFAULT_NAME


def test_duplicate_count_and_missing_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    assert B.duplicate_count(df).first()["duplicates"] == 1
    prof = {r["column"]: r["missing"] for r in B.missing_profile(df).collect()}
    assert prof == {"v": 2, "k": 0}
