"""Sources and sinks, skew of score chunks, exact means, density cells, stored models."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import binary_metrics as M
from ledgerlens.operators import cleaning as B
from ledgerlens.operators import monitoring as I
from ledgerlens.operators import prep as G
from ledgerlens.operators import stats as D
from ledgerlens.operators.density import density_labels, density_settings
from ledgerlens.sources import files as A


def test_csv_by_name_and_absent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("PAYMENT", 1, 9.5), (None, None, None)], "type string, step int, ` amount ` double")
    A.write_csv(df, path)
    got = A.load_transactions(spark, path)
    assert [c.split()[0] for c in A.TRANSACTION_SCHEMA.split(", ")] == got.columns
    assert sorted(map(str, got.select("step", "type", "amount", "isFraud").collect())) == sorted(
        ["Row(step=1, type='PAYMENT', amount=9.5, isFraud=None)", "Row(step=None, type=None, amount=None, isFraud=None)"])
    none = A.read_or_empty(spark, path + "x", A.CUSTOMER_SCHEMA)
    assert none.count() == 0 and A.row_count(none).first()["rows"] == 0


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_metric_round_trip(spark, tmp_path, kind):
    path = f"file://{tmp_path}/{kind}"
    A.write_metrics(spark.createDataFrame([("a", 0.25, 3)], "model string, threshold double, n long"), path, kind)
    assert [tuple(r) for r in A.read_metrics(spark, path, kind, "threshold double, model string").collect()] == [(0.25, "a")]


def test_missing_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    got = I.missing_artifacts(spark, f"file://{tmp_path}", ["a.json", "b.json"])
    assert [r.name for r in got.collect()] == ["b.json"]
    assert I.missing_artifacts(spark, f"file://{tmp_path}/none", ["a.json"]).count() == 1


def test_crowded_scores_share_no_chunk(spark):
    df = spark.range(20_000).select(F.pow(F.rand(1), 8).alias("proba"), (F.rand(2) < 0.01).cast("int").alias("y"))
    counts = M.score_counts(df)
    most = M.with_score_chunk(counts).groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert most < 0.02 * counts.count()


def test_exact_means_round_halves_up(spark):
    df = spark.createDataFrame([(1, 4825.76), (1, 4825.77), (1, None), (2, -0.005), (3, None)], "cluster int, Income double")
    got = {r["cluster"]: r["Income"] for r in D.profile_clusters(df).collect()}
    assert got == {1: 4825.77, 2: -0.01, 3: None}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 2, None), (1, None, 3, 5)], "a int, b int, c int, d int")
    assert sorted(r["column"] for r in B.constant_columns(df).collect()) == ["a", "b"]
    assert B.constant_columns(df.limit(0)).count() == 0


def test_density_cells(spark):
    rows = [(i, [(i % 8) * 0.05, (i // 8) * 0.05]) for i in range(64)]
    rows += [(100 + i, [50 + (i % 8) * 0.05, 50 + (i // 8) * 0.05]) for i in range(64)] + [(999, [20.0, -20.0])]
    df = spark.createDataFrame(rows, "ID long, features array<double>")
    got = density_settings(density_labels(df, "ID", "features", 2, [1.0], [5, 1000]), df, "ID").collect()
    by = {r["min_points"]: r for r in got}
    assert by[5]["n_clusters"] == 2 and by[5]["noise"] == 1 and by[5]["status"] == "evaluated"
    assert by[1000]["n_clusters"] == 0 and by[1000]["status"] == "rejected_too_few_clusters"


def test_many_categories_go_by_a_table(spark, monkeypatch, tmp_path):
    """Beyond the limit the vectors are the same, sparse, and a model keeps the table."""
    from pyspark.ml.functions import vector_to_array
    from ledgerlens.operators import modeling as L
    i = F.col("id")
    df = spark.range(300).select(i.alias("event_id"), (i % 11 / 11).alias("x"), F.when(i % 9 != 0, F.concat(F.lit("v"), (i % 13).cast("string"))).alias("c"),
                                 (i % 3).cast("string").alias("d"), (i % 13 > 6).cast("int").alias("isFraud"),
                                 F.when(i % 10 < 6, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"))
    new = df.unionByName(spark.createDataFrame([(900, 0.5, "unseen", "1", 0, "test"), (901, None, None, None, 0, "test")], df.schema))
    lists = G.Preparer.fit(df, ["x"], ["d", "c"])
    monkeypatch.setattr(G, "MAX_CATEGORIES", 5)
    tables = G.Preparer.fit(df, ["x"], ["d", "c"])
    assert list(tables.categorical) == ["d"] and list(tables.tables) == ["c"] and tables.n_outputs() == lists.n_outputs() == len(tables.output_names())
    rows = lambda p: {r.event_id: tuple(r.v) for r in p.to_vector(p.aligned(new, ["event_id"]), ["event_id"]).select("event_id", vector_to_array("features").alias("v")).collect()}
    # both have x, then d's columns, then c's, whatever order the features were listed in
    names = lists.output_names()
    order = [names.index(n) for n in [n for n in names if not n.startswith("cat__c_")] + [n for n in names if n.startswith("cat__c_")]]
    assert rows(tables) == {k: tuple(v[j] for j in order) for k, v in rows(lists).items()}
    assert sum(rows(tables)[900][4:]) == 0
    fitted, _ = L.train_and_evaluate(df, L.ModelConfig("logistic_regression", L.logistic_regression()))
    fitted.save(f"file://{tmp_path}/m")
    assert fitted.score(new, ["event_id"]).collect() == L.FittedModel.load(f"file://{tmp_path}/m").score(new, ["event_id"]).collect()


def test_places_of_values_are_sorted(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("string").alias("c"), F.concat(F.lit("k"), F.col("id") % 3).alias("d"))
    got = G.numbered(G.category_counts(df, ["c", "d"])).collect()
    for f in ("c", "d"):
        assert [r["v"] for r in sorted((r for r in got if r["feature"] == f), key=lambda r: r["index"])] == sorted({r["v"] for r in got if r["feature"] == f})
        assert sorted(r["index"] for r in got if r["feature"] == f) == list(range(sum(r["feature"] == f for r in got)))


def test_model_is_stored_and_loaded(spark, tmp_path):
    from ledgerlens.operators import modeling as L
    df = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 7 / 7).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
                                 (F.col("id") % 7 > 4).cast("int").alias("isFraud"),
                                 F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))
    fitted, metrics = L.train_and_evaluate(df, L.ModelConfig("logistic_regression", L.logistic_regression()))
    folder = f"file://{tmp_path}/models"
    fitted.save(f"{folder}/model")
    loaded = L.load_model(folder, "logistic_regression")  # only the generic one is there
    same = fitted.score(df, ["event_id"]).collect()
    assert same == loaded.score(df.drop("isFraud").withColumn("more", F.lit(1)), ["event_id"]).collect()
    assert len(loaded.score(df.drop("c"), ["event_id"]).collect()) == 400
    assert metrics.first()["train_size"] == fitted.train_size == 240
    with pytest.raises(FileNotFoundError):
        L.load_model(f"{folder}/none", "a")
