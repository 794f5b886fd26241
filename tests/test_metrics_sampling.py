"""Classification metrics against brute force on literal rows; sampling sizes."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import binary_metrics as M
from ledgerlens.operators import sampling as E

ROWS = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.4, 1), (0.1, 0)]


def _brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return auc, ap


def test_ranking_metrics_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "proba double, y int")
    r = M.ranking_metrics(df).first()
    auc, ap = _brute(ROWS)
    assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)


def test_threshold_counts_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "proba double, y int")
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in M.threshold_counts(df, [0.1, 0.5, 0.8, 0.95]).collect()}
    for t, (tp, fp) in got.items():
        assert tp == sum(1 for s, y in ROWS if s >= t and y == 1)
        assert fp == sum(1 for s, y in ROWS if s >= t and y == 0)


def test_best_threshold_defaults_when_recall_impossible(spark):
    df = spark.createDataFrame([(0.01, 1), (0.02, 0)], "proba double, y int")
    assert M.best_threshold(df, 0.75).first()["threshold"] == 0.5


def test_error_cases_fall_back_to_quasi_false_positives(spark):
    df = spark.createDataFrame([(1, 0.6, 0), (2, 0.7, 0), (3, 0.2, 1)], "id int, proba double, y int")
    labels = {r["case_label"] for r in M.error_cases(df, 0.9, "id").collect()}
    assert labels == {"false_negative", "quasi_false_positive_threshold_0.5"}


def test_sample_and_splits_have_exact_sizes(spark):
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert E.sample_n(df, 123, "id").count() == 123
    split = {(r["y"], r["split"]): r["n"] for r in
             E.stratified_split(df, "y", "id").groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert split[(1, "test")] == 30 and split[(0, "test")] == 270
    s = E.stratified_sample(df, "y", "id", 500)
    assert s.count() == 500 and s.where("y = 1").count() == 50
