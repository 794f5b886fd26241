"""Medians found between two values of a sketch, models of many rows, and the design made once."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from ledgerlens.operators import modeling as G
from ledgerlens.operators import quantiles
from ledgerlens.operators.prep import Preparer, fit_numeric
from ledgerlens.plans import catalog  # noqa: F401  (before the queries, which it loads)
from ledgerlens.plans import queries_models as Q


def odd_columns(spark, n=4000):
    i = F.col("id")
    return spark.range(n).repartition(3).select(
        (i * 7919 % n).cast("double").alias("plain"), F.when(i % 3 == 0, i * 31 % 97).alias("holes"), F.lit(2.5).alias("same"), (i % 2).cast("double").alias("halves"),
        F.when(i % 10 == 0, F.lit(float("nan"))).otherwise((i * 13 % 1009).cast("double")).alias("nans"), F.lit(None).cast("double").alias("none"),
        F.when(i % 5 < 2, F.lit(float("-inf"))).when(i % 5 < 4, F.lit(float("inf"))).otherwise(i.cast("double")).alias("ends"),
        F.when(i % 2 == 0, -0.0).otherwise(0.0).alias("zeros"), F.when(i == 5, 1.0).alias("one"), (i % 50).cast("decimal(10,2)").alias("money"))


@pytest.mark.parametrize("p", [0.0, 0.0002, 0.25, 0.5, 0.731, 1.0])
def test_quantiles_of_columns_are_exact(spark, p):
    df = odd_columns(spark).cache()
    spec = {f"{c}_q": (c, p) for c in df.columns}
    want = quantiles.grouped_quantiles(df, spec).first().asDict()
    with quantiles.settling(20):
        got = quantiles.column_quantiles(df, spec)
    assert got == want and str(got["zeros_q"]) == "0.0" and got["none_q"] is None
    plain = np.quantile([r.plain for r in df.collect()], p)
    assert got["plain_q"] == pytest.approx(plain)


def test_a_rank_outside_its_two_values_is_found(spark, monkeypatch):
    df = odd_columns(spark).select("plain", "money")
    want = quantiles.grouped_quantiles(df, {"a": ("plain", 0.5), "b": ("money", 0.5)}).first().asDict()
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 3)
    monkeypatch.setattr(quantiles, "SKETCH_MARGIN", 1e-9)
    with quantiles.settling(20):
        assert quantiles.column_quantiles(df, {"a": ("plain", 0.5), "b": ("money", 0.5)}) == want


def test_preparation_ranks_few_values(spark, monkeypatch):
    df = odd_columns(spark).drop("ends", "nans", "halves").cache()
    ranked = []
    real = quantiles.value_ranges
    monkeypatch.setattr(quantiles, "value_ranges", lambda values, keys: ranked.append(values.count()) or real(values, keys))
    with quantiles.settling(20):
        got = {r.feature: r for r in fit_numeric(df, df.columns).collect()}
    assert sum(ranked) < 500  # not a row a value
    x = df.toPandas().astype(float)
    assert got.keys() == set(df.columns) and got["none"].mean is None
    for c in set(df.columns) - {"none"}:
        v = x[c].fillna(x[c].median())
        assert [got[c]["median"], got[c]["mean"], got[c]["std"]] == pytest.approx([x[c].median(), v.mean(), v.std(ddof=0)]), c
    assert fit_numeric(df.limit(0), ["plain"]).count() == 0 and Preparer.fit(df.limit(0), ["plain"], []).numeric == {}


def rows(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(i.alias("event_id"), (i * 37 % 101 / 101).alias("x"), (i * 17 % 29 / 29).alias("z"), F.when(i % 3 == 0, "a").otherwise("b").alias("c"),
                                 (i * 37 % 101 + i * 17 % 29 > 70).cast("int").alias("isFraud"), F.when(i % 10 < 6, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"))


def test_vectors_of_many_rows_lie_in_equal_parts_on_disk(spark, monkeypatch):
    seen = []
    real = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: seen.append((df.rdd.glom().map(len).collect(), df.storageLevel)) or real(self, df, *a))
    df = rows(spark).coalesce(1)
    config = G.ModelConfig("logistic_regression", G.logistic_regression())
    few = G.train_and_evaluate(df, config)[0]
    monkeypatch.setattr(G, "ROWS_PER_PARTITION", 10)
    monkeypatch.setattr(G, "MOST_ROWS_PER_PARTITION", 50)
    many = G.train_and_evaluate(df, config)[0]
    (one, _), (parts, level) = seen
    cores = spark.sparkContext.defaultParallelism
    assert one == [360] and len(parts) == cores * -(-360 // (cores * 50)) and max(parts) - min(parts) <= 1 and sum(parts) == 360
    assert level.useDisk and not level.useMemory
    assert many.model.coefficients.toArray() == pytest.approx(few.model.coefficients.toArray(), rel=1e-3, abs=1e-3)


def test_a_forest_of_many_rows_grows_some_trees_at_a_time(spark, monkeypatch, tmp_path):
    grown = []
    real = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: grown.append((self.getNumTrees(), self.getSeed())) or real(self, df))
    config, df = G.ModelConfig("random_forest", G.random_forest(8)), rows(spark)
    G.train_and_evaluate(df, config)
    assert grown == [(8, 42)]
    monkeypatch.setattr(G, "COUNTS_PER_CORE", 3 * 360 // spark.sparkContext.defaultParallelism)
    fitted, metrics = G.train_and_evaluate(df, config)
    assert [n for n, _ in grown[1:]] == [3, 3, 2] and len({s for _, s in grown[1:]}) == 3
    model = fitted.model
    assert len(model.trees) == 8 and len({t.toDebugString for t in model.trees}) > 3 and metrics.first().roc_auc > 0.9
    assert sum(model.featureImportances.toArray()) == pytest.approx(1) and G.feature_importance(fitted).count() == 4
    each = np.mean([t.featureImportances.toArray() for t in model.trees], axis=0)
    assert model.featureImportances.toArray() == pytest.approx(each / each.sum())
    fitted.save(f"file://{tmp_path}/m")
    loaded = G.FittedModel.load(f"file://{tmp_path}/m")
    assert sorted(map(tuple, loaded.score(df, ["event_id"]).collect())) == sorted(map(tuple, fitted.score(df, ["event_id"]).collect()))
    assert fitted.scores.count() == 240


def test_the_design_is_made_once(spark, tmp_path, monkeypatch):
    made = []
    def balances(spark, sf):
        made.append(sf)
        i = F.col("id")
        return spark.range(60).select(i.alias("event_id"), (i % 9).cast("int").alias("step"), F.lit("a").alias("type"), (i * 1.5).alias("amount"), (i % 4).alias("nameOrig"), (i % 2).alias("nameDest"),
                                      (i % 6 == 0).cast("int").alias("isFraud"), (i % 3).cast("double").alias("oldbalanceOrg"), (i * 1.0).alias("newbalanceOrig"), (i * 2.0).alias("oldbalanceDest"), (i * 3.0).alias("newbalanceDest"))
    monkeypatch.setattr(Q, "T", balances)
    split = Q._fraud_split(spark, str(tmp_path))
    assert Q._fraud_split(spark, str(tmp_path), temporal=True).count() == split.count() == 60
    assert Q._fraud_design(spark, str(tmp_path)).count() == 60 and len(made) == 1
