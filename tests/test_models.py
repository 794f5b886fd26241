"""Tree contributions, early stopping and stored segment models."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlens.operators import modeling as G


def split(spark, n=400):
    r = spark.range(n)
    x, z = (F.col("id") * 37 % 101) / 101, (F.col("id") * 17 % 29) / 29
    return r.select(F.col("id").alias("event_id"), x.alias("x"), z.alias("z"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("c"),
                    ((x + z + (F.col("id") % 3 == 0).cast("int") * 0.4) > 1.2).cast("int").alias("isFraud"),
                    F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_contributions_sum_to_the_raw_score(spark, kind):
    df = split(spark)
    build = G.boosted_trees(6, depth=4, bins=32) if kind == "boosted" else G.random_forest(7)
    fitted, _ = G.train_and_evaluate(df, G.ModelConfig(kind, build, G.positive_weight if kind == "boosted" else G.balanced_weights))
    glob, per_row, sums = G.tree_contributions(fitted, df, "event_id", 2)
    out = fitted.model.transform(fitted.prep.to_vector(fitted.prep.aligned(df, ["event_id"]), ["event_id"]))
    # a forest's raw score counts trees; its probability is the mean over them
    raw = {r.event_id: r.raw for r in out.select("event_id", vector_to_array("rawPrediction" if kind == "boosted" else "probability")[1].alias("raw")).collect()}
    got = {r.event_id: r.total for r in sums.collect()}
    assert got.keys() == raw.keys() and max(abs(got[k] - raw[k]) for k in raw) < 1e-9
    names = fitted.prep.output_names()
    assert sorted(r.feature for r in glob.collect()) == sorted(names) and len({r.base for r in sums.collect()}) == 1
    rows = per_row.collect()
    assert len(rows) == 2 * 400 and {r.rank for r in rows} == {1, 2}
    by = {}
    for r in rows:
        by.setdefault(r.event_id, {})[r["rank"]] = abs(r.c)
    assert all(v[1] >= v[2] for v in by.values())


def vectors(spark, n=600):
    rows = [(Vectors.dense([(i * 37 % 101) / 101, (i * 17 % 29) / 29]), float((i * 37 % 101) / 101 + (i * 17 % 29) / 29 > 1)) for i in range(n)]
    return spark.createDataFrame(rows, ["features", "label"])


def test_training_stops_and_keeps_the_best_weights(spark):
    df = vectors(spark)
    est = G.EarlyStoppingPerceptron([2, 4, 2], iters=400, step=10, patience=2, tol=0.05)
    model = est.fit(df)
    assert len(est.losses) < 40, est.losses  # before the cap
    best = min(range(len(est.losses)), key=lambda i: est.losses[i])
    kept = [i for i, x in enumerate(est.losses) if all(x < y - est.tol for y in est.losses[:i])][-1]
    assert kept <= best and len(est.losses) - 1 - kept >= est.patience
    again = G.EarlyStoppingPerceptron([2, 4, 2], iters=10 * (kept + 1), step=10, patience=99, tol=-1e9).fit(df)
    assert model.weights.toArray().tolist() == pytest.approx(again.weights.toArray().tolist())


def test_rows_of_one_side_only(spark):
    est = G.EarlyStoppingPerceptron([2, 3, 2], iters=4, step=2, fraction=0.0)
    assert est.fit(vectors(spark, 40)) is not None and est.losses == []


def customers(spark, n=60):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("ID"), (1950 + i % 40).cast("int").alias("Year_Birth"), F.when(i % 7 != 0, 1000.0 + i * 10).alias("Income"), F.when(i % 2 == 0, "x").otherwise("y").alias("Education"),
        F.format_string("%02d/0%d/2020", (i % 28 + 1).cast("int"), (i % 9 + 1).cast("int")).alias("Dt_Customer"),
        *[(i * k % 50 + F.when(i % 3 == 0, 400).otherwise(0)).cast("double").alias(c) for k, c in enumerate(["MntWines", "MntFruits", "MntMeatProducts"], 3)],
        *[(i % k).cast("int").alias(c) for k, c in enumerate(["NumDealsPurchases", "NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases"], 2)],
        F.lit(3).alias("Z_CostContact"), F.lit(11).alias("Z_Revenue"), (i % 2).cast("int").alias("Response"))


def test_segments_don_t_depend_on_the_rows_beside(spark, tmp_path):
    """The median, the last date and the scaling are the training's, also for one row."""
    df = customers(spark).cache()
    model = G.SegmentModel.fit(df, 3, restarts=3)
    model.save(f"file://{tmp_path}/m")
    loaded = G.SegmentModel.load(f"file://{tmp_path}/m")
    whole = {r.ID: r.cluster for r in loaded.score(df).collect()}
    assert whole == {r.ID: r.cluster for r in model.score(df).collect()} and len(set(whole.values())) == 3
    for i in (0, 7, 13):
        one = df.where(F.col("ID") == i)
        assert {r.ID: r.cluster for r in loaded.score(one).collect()} == {i: whole[i]}
        f = loaded.features(one).first()
        assert f.Customer_Tenure_days == loaded.features(df).where(F.col("ID") == i).first().Customer_Tenure_days
    assert loaded.features(df.where("ID = 7")).first().Income == loaded.income_median
    assert len(loaded.score(df.drop("Education", "MntWines")).collect()) == 60


def test_metrics_recomputed_by_sql_from_the_stored_scores(spark):
    """F1-F3 and the threshold, by DuckDB over the rows that the model stored."""
    import duckdb
    fitted, metrics = G.train_and_evaluate(split(spark, 900), G.ModelConfig("logistic_regression", G.logistic_regression()))
    rows = [tuple(r) for r in fitted.scores.select("event_id", "y", "split", "proba").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE s(event_id BIGINT, y INT, split VARCHAR, proba DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    best = con.execute("""
        WITH g AS (SELECT i / 100 t FROM range(5, 100) r(i)),
        c AS (SELECT t, count_if(y = 1 AND proba >= t) tp, count_if(y = 0 AND proba >= t) fp, count_if(y = 1 AND proba < t) fn FROM s, g WHERE split = 'val' GROUP BY t)
        SELECT t FROM c WHERE tp / greatest(tp + fn, 1) >= 0.75 ORDER BY 2.0 * tp / nullif(2 * tp + fp + fn, 0) DESC NULLS LAST, t LIMIT 1""").fetchone()[0]
    assert fitted.threshold == pytest.approx(best)
    want = con.execute(f"""
        WITH p AS (SELECT * FROM s WHERE split = 'test'),
        c AS (SELECT count_if(y = 1 AND proba >= {fitted.threshold}) tp, count_if(y = 0 AND proba >= {fitted.threshold}) fp, count_if(y = 1 AND proba < {fitted.threshold}) fn, count(*) n FROM p),
        k AS (SELECT proba, count_if(y = 1) pos, count_if(y = 0) neg FROM p GROUP BY 1),
        w AS (SELECT *, sum(pos) OVER (ORDER BY proba DESC) tp, sum(neg) OVER (ORDER BY proba DESC) fp FROM k)
        SELECT tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), (n - fp - fn) / n, (SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM w),
               (SELECT sum(neg * (2 * tp - pos)) / (2.0 * sum(pos) * sum(neg)) FROM w) FROM c""").fetchone()
    m = metrics.first()
    assert [m.precision, m.recall, m.f1, m.accuracy, m.pr_auc, m.roc_auc] == pytest.approx(list(want))
