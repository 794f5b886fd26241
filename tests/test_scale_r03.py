"""Runs of k-means together, wide summaries and sums by batch against the plain forms."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlens.operators import clustering as H
from ledgerlens.operators import modeling as G
from ledgerlens.operators import quantiles
from ledgerlens.operators import stats as D


def points(spark, n=500, d=3):
    x = np.random.default_rng(3).normal(size=(n, d)).round(3)
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["id", "features"]).coalesce(2)


def test_runs_together_cost_what_each_run_costs(spark):
    df = points(spark).cache()
    runs = [(2, 1), (3, 5), (3, 6), (5, 7)]
    want = [KMeans(k=k, seed=s, maxIter=300).fit(df).summary.trainingCost for k, s in runs]
    assert H.kmeans_costs(df, runs) == pytest.approx(want, rel=1e-9)
    best = H.best_restarts(df, [2, 4], 5)
    each = [KMeans(k=4, seed=42 + r, maxIter=300).fit(df).summary.trainingCost for r in range(5)]
    assert best[4][0] == 42 + int(np.argmin(each)) or best[4][1] == pytest.approx(min(each), rel=1e-9)
    assert H.fit_kmeans(df, 4, 5).summary.trainingCost == pytest.approx(min(each), rel=1e-9)


def test_runs_of_few_distinct_rows(spark):
    df = spark.createDataFrame([(i, Vectors.dense([float(i % 2)])) for i in range(8)], ["id", "features"])
    want = [KMeans(k=k, seed=2, maxIter=300).fit(df).summary.trainingCost for k in (2, 5)]
    assert H.kmeans_costs(df, [(2, 2), (5, 2)]) == pytest.approx(want)


def test_point_sums_by_batch_and_by_columns(spark, monkeypatch):
    rows = [(m, i % k if i else 99, [float(i * 37 % 11), float(i * 17 % 7), 0.5]) for m, k in (("a", 3), ("b", 1), ("c", 4)) for i in range(40)]
    rows += [("b1", 0, [float(i), 1.0, 2.0]) for i in range(5)] + [("same", i % 2, [1.0, 1.0, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "m string, cluster int, features array<double>")
    calls = []
    slow = H._point_sums_by_columns
    monkeypatch.setattr(H, "_point_sums_by_columns", lambda *a: calls.append(1) or slow(*a))
    fast = {r.m: r for r in H.cluster_metrics(df, by=["m"]).collect()}
    assert not calls
    monkeypatch.setattr(H, "MAX_BROADCAST_CELLS", 0)
    plain = {r.m: r for r in H.cluster_metrics(df, by=["m"]).collect()}
    assert calls and fast.keys() == plain.keys() == {"a", "b", "c", "b1", "same"}
    for m, r in plain.items():
        assert [x for x in fast[m][1:]] == [x if x is None else pytest.approx(x, rel=1e-9, abs=1e-9) for x in r[1:]], m


def test_describe_keeps_rows_wide(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("a"), (F.col("id") % 11).alias("b"), F.lit(None).cast("double").alias("c"))
    seen = []
    real = quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda d, name: seen.append(d.count()) or real(d, name))
    got = {(r.g, r.column): r for r in D.describe(df, ["a", "b", "c"], ["g"]).collect()}
    assert seen == [60]  # not a row a value
    x = df.toPandas()
    for g in (0, 1):
        for c in ("a", "b"):
            w = x[x.g == g][c].astype(float).describe()
            r = got[g, c]
            assert [r["count"], r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max] == pytest.approx(w.tolist())
        assert got[g, "c"]["count"] == 0 and got[g, "c"].q50 is None and got[g, "c"].mean is None
    assert D.describe(df.limit(0), ["a"]).count() == 0


def test_mean_contributions_are_sums_of_columns(spark):
    r = spark.range(300)
    df = r.select(F.col("id").alias("event_id"), (F.col("id") * 37 % 101).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
                  (F.col("id") * 37 % 101 > 60).cast("int").alias("isFraud"), F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))
    fitted, _ = G.train_and_evaluate(df, G.ModelConfig("logistic_regression", G.logistic_regression()))
    glob, per_row = G.linear_contributions(fitted, df, "event_id", 3)
    of = {}
    for t in per_row.collect():
        of.setdefault(t.feature, []).append(t.c)
    assert {t.feature: (t.mean_abs, t.mean) for t in glob.collect()} == {f: (pytest.approx(np.abs(v).mean()), pytest.approx(np.mean(v), abs=1e-12)) for f, v in of.items()}
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        glob.explain("extended")
        per_row.explain("extended")
    assert "array_sort" not in said.getvalue()  # its comparison is interpreted, value by value
    assert G.linear_contributions(fitted, df.limit(0), "event_id")[0].count() == 0


def test_boosted_trees_find_nodes_from_the_root(spark):
    assert not G.boosted_trees(3)(4).getCacheNodeIds() and not G.boosted_trees(3, depth=5, bins=255)(4).getCacheNodeIds()


def test_nearest_centre_by_products_is_the_plain_one():
    from ledgerlens.operators.ward import nearest_centres
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.normal(size=(40, 5)).round(1), np.zeros((2, 5))])
    c = np.concatenate([c, c[3:9]])  # repeated centres: ties
    x = np.concatenate([rng.normal(size=(300, 5)).round(1), c, (c[:10] + c[10:20]) / 2])
    assert nearest_centres(x, c).tolist() == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
