"""Models of all training rows, the silhouette of all pairs, and training that scales."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B
from ledgerlens.operators import clustering as H
from ledgerlens.operators import modeling as G
from ledgerlens.operators import silhouette as S
from ledgerlens.plans import catalog  # noqa: F401  (before the queries, which it loads)
from ledgerlens.plans import queries_models as Q


def test_the_perceptron_learns_from_all_training_rows(spark):
    i = F.col("id")
    df = spark.range(230_000).select(i.alias("event_id"), (i * 37 % 101 / 101).alias("x"), (i % 5 == 0).cast("int").alias("isFraud"),
                                     F.when(i % 10 < 9, "train").when(i % 20 < 10, "val").otherwise("test").alias("split"))
    fitted, metrics = G.train_and_evaluate(df, replace(Q.BY_NAME["mlp"], build=G.perceptron((2,), iters=2)))
    assert fitted.train_size == metrics.first().train_size == 207_000


def rows(spark, n=3000):
    i = F.col("id")
    x, z = (i * 7919 % 1009) / 1009, (i * 104729 % 2003) / 2003
    return spark.range(n).select(i.alias("event_id"), x.alias("x"), z.alias("z"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("c"), F.lit(1.5).alias("same"),
                                 ((x * z + (i % 3 == 0).cast("int") * 0.2 + (i * 31 % 17) / 60) > 0.55).cast("int").alias("isFraud"),
                                 F.when(i % 10 < 6, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"))


BOOSTED = G.ModelConfig("gradient_boosting", G.boosted_trees(12, depth=4, step=0.3), G.positive_weight)


@pytest.mark.parametrize("one_task", [True, False])
def test_boosted_trees_of_many_rows(spark, monkeypatch, one_task):
    df = rows(spark)
    few = G.train_and_evaluate(df, BOOSTED)[1].first()
    monkeypatch.setattr(G, "ROWS_PER_PARTITION", 10)
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, d, real=GBTClassifier._fit: real(self, d) if d.count() == 2 else pytest.fail("all rows went to MLlib"))
    if not one_task:
        monkeypatch.setattr(B, "ONE_TASK", 0)
        monkeypatch.setattr(B, "LEAST_ROWS", 300)
    fitted, metrics = G.train_and_evaluate(df, BOOSTED)
    many = metrics.first()
    assert len(fitted.model.trees) == 12 and many.roc_auc == pytest.approx(few.roc_auc, abs=0.02) and many.pr_auc == pytest.approx(few.pr_auc, abs=0.03)
    assert max(t.depth for t in fitted.model.trees) == 4 and fitted.model.treeWeights[:2] == [1.0, 0.3]
    assert sum(fitted.model.featureImportances.toArray()) == pytest.approx(1)
    test = df.where("split = 'test'")
    raw = {r.event_id: r.raw for r in fitted.model.transform(fitted.prep.to_vector(test, ["event_id"])).select("event_id", vector_to_array("rawPrediction")[1].alias("raw")).collect()}
    assert {r.event_id: r.total for r in G.tree_contributions(fitted, test, "event_id")[2].collect()} == pytest.approx(raw)


def sums_of(x, thresholds, y, w, chosen):
    """Weight, pull and square of the rows on the left of each threshold, by brute force."""
    return [(w[chosen & (x <= t)].sum(), (w * y)[chosen & (x <= t)].sum()) for t in thresholds]


def test_a_tree_is_the_best_one_by_brute_force():
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 40, 400), rng.integers(0, 3, 400), rng.integers(0, 12, 400)], axis=1).astype(float)
    y, w = np.where(x[:, 0] * (x[:, 1] - 1) + rng.normal(0, 9, 400) > 3, 1.0, -1.0), rng.integers(1, 4, 400) * 0.37
    plan = B.layout([np.arange(39) + 0.5, np.array([0.5, 1.5]), np.arange(11) + 0.5])
    assert len(plan.packs) == 2  # 40 x 12 bins, and 3 alone
    joint = np.zeros((2, 400), np.uint16)
    for f, (g, factor) in plan.place().items():
        joint[g] += (np.searchsorted(plan.thresholds[f], x[:, f]) * factor).astype(np.uint16)
    held = B._Held([(1, joint[:, a], y[a], w[a], np.ones(len(y[a]))) for a in (slice(0, 150), slice(150, 400))], plan, 3, 1.0, 7)
    trees = B.boost(held, plan, 3, 3, w.min(), 2, 0.1)
    pull = y
    for t in trees:
        node = B.nodes_of(plan, t, joint, 3)
        chosen = {0: np.ones(400, bool)}
        for i in range(7):
            if i not in chosen:
                continue
            of = chosen[i]
            assert [t.weight[i], t.total[i], t.count[i], t.square[i]] == pytest.approx([w[of].sum(), (w * pull)[of].sum(), of.sum(), (w * pull ** 2)[of].sum()])
            gains = {(f, b): l_s ** 2 / l_w + (t.total[i] - l_s) ** 2 / (t.weight[i] - l_w) - t.total[i] ** 2 / t.weight[i]
                     for f in range(3) for b, (l_w, l_s) in enumerate(sums_of(x[:, f], plan.thresholds[f], pull, w, of)) if 0 < l_w < t.weight[i] - 1e-9}
            if t.feature[i] < 0:
                assert not gains or max(gains.values()) < 1e-9
                continue
            assert t.gain[i] * t.weight[i] == pytest.approx(max(gains.values())) == pytest.approx(gains[t.feature[i], t.cut[i]])
            left = x[:, t.feature[i]] <= plan.thresholds[t.feature[i]][t.cut[i]]
            chosen[2 * i + 1], chosen[2 * i + 2] = of & left, of & ~left
        assert sum((node == i).sum() for i in range(15) if t.feature[i] < 0) == 400
        margin = t.value()[node] * t.step if t.step == 1 else margin + t.value()[node] * t.step  # noqa: F821
        pull = 4 * y / (1 + np.exp(2 * y * margin))
    assert [t.step for t in trees] == [1.0, 0.1] and trees[0].count[0] == 400


def test_thresholds_come_from_all_rows(spark):
    nan = float("nan")
    df = spark.range(9000).repartition(3).select(F.array(F.col("id").cast("double"), (F.col("id") % 4).cast("double"), F.when(F.col("id") == 8999, 7.0).otherwise(0.0), F.lit(1.0),
                                                         F.when(F.col("id") % 2 == 0, nan).otherwise(F.col("id") % 3).cast("double")).alias("_x"))
    a, b, c, d, e = B.find_thresholds(df, 5, 32)
    assert len(a) == 31 and np.abs(a - np.arange(1, 32) * 9000 / 32).max() < 20
    assert b.tolist() == [0.5, 1.5, 2.5] and c.tolist() == [3.5] and d.tolist() == [] and e.tolist() == [0.5, 1.5]


def test_paths_of_leaves_are_the_sums_of_their_steps(spark, monkeypatch):
    df = rows(spark, 400)
    fitted, _ = G.train_and_evaluate(df, BOOSTED)
    want = {r.event_id: (r.base, r.total) for r in G.tree_contributions(fitted, df, "event_id")[2].collect()}
    means = {r.feature: (r.mean_abs, r["mean"]) for r in G.tree_contributions(fitted, df, "event_id")[0].collect()}
    monkeypatch.setattr(G, "MOST_PATH_NUMBERS", 0)
    glob, _, sums = G.tree_contributions(fitted, df, "event_id")
    assert {r.event_id: r.base for r in sums.collect()} == {k: v[0] for k, v in want.items()}
    assert {r.event_id: r.total for r in sums.collect()} == pytest.approx({k: v[1] for k, v in want.items()})
    for r in glob.collect():
        assert means[r.feature] == pytest.approx((r.mean_abs, r["mean"]))


def test_fits_of_many_rows_don_t_share_memory(spark, monkeypatch):
    assert [G.fits_at_once(n, 6) for n in (1000, 299_999, 300_000, 12_000_000, 12_000_001)] == [5, 5, 2, 2, 1]
    prepared, open_, most = [], [], []
    monkeypatch.setattr(G.Preparer, "fit", classmethod(lambda cls, df, *a, real=G.Preparer.fit.__func__: prepared.append(1) or real(cls, df, *a)))

    def fit(self, df, *a, real=LogisticRegression.fit):
        open_.append(1)
        most.append(len(open_))
        try:
            return real(self, df, *a)
        finally:
            open_.pop()

    monkeypatch.setattr(LogisticRegression, "fit", fit)
    monkeypatch.setattr(G, "ROWS_PER_PARTITION", 10)
    monkeypatch.setattr(G, "ROWS_OF_TWO_FITS", 10)
    models, metrics = G.compare_models(rows(spark, 600), [G.ModelConfig(f"m{i}", G.logistic_regression()) for i in range(3)])
    assert len(prepared) == 1 and len(most) == 3 and max(most) == 1 and metrics.count() == len(models) == 3


def all_pairs(x, c):
    """The mean silhouette, each row against all others."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    names = np.unique(c)
    mean = np.stack([d[:, c == k].sum(axis=1) / np.maximum((c == k).sum() - (c == k), 1) for k in names], axis=1)
    own = c[:, None] == names
    a, b = mean[own], np.where(own, np.inf, mean).min(axis=1)
    top = np.maximum(a, b)
    return float(np.where((own * own.sum(axis=0)).sum(axis=1) > 1, np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0), 0).mean())


def test_silhouette_takes_all_pairs(spark, monkeypatch):
    """Over 1,000 rows a cluster, repeated vectors (also in other clusters), keys that repeat, one row alone."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(m, s, size=(n, 3)) for m, s, n in ((0, 1, 1300), (2, 0.5, 1100), (5, 2, 60))] + [np.zeros((5, 3)) + 1e6]).round(2)
    c = np.repeat([0, 1, 2, 3, 0, 7], [1300, 1100, 60, 3, 1, 1])
    x[2000:2300], x[5] = x[1500:1800], x[1400]
    df = spark.createDataFrame([(i % 9 or None, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), c))], "id long, features array<double>, cluster int")
    both = df.selectExpr("id", "features", "cluster", "'a' model").unionByName(df.selectExpr("id", "features", "cluster % 2 cluster", "'b' model"))
    both = both.unionByName(df.selectExpr("id", "features", "3 cluster", "'one' model"))
    monkeypatch.setattr(S, "BLOCK", 200)
    got = {r.model: r for r in S.silhouette(both, "id", by=["model"]).collect()}
    assert got["a"].silhouette == pytest.approx(all_pairs(x, c), abs=1e-9) and got["b"].silhouette == pytest.approx(all_pairs(x, c % 2), abs=1e-9)
    assert got["one"].silhouette == -1.0 and {r.silhouette_error for r in got.values()} == {0.0}
    assert S.silhouette(df.limit(0), "id").columns == ["silhouette", "silhouette_error"] and S.silhouette(df.limit(0), "id").count() == 0


def test_distances_that_cancel_are_taken_by_difference():
    x = np.array([[1e6, 0.0], [1e6, 1e-3], [1e6, 0.0]])
    got = S.block_sums(x, x, np.array([0, 2]), np.array([[1.0, 0.0], [0.0, 2.0]]))
    assert got == pytest.approx(np.array([[1e-3, 0.0], [1e-3, 2e-3], [1e-3, 0.0]]))


def test_sums_of_all_runs_by_brute_force(monkeypatch):
    """Counts, sums and costs of every run of every k, ties to the smallest centre, a few distances at a time."""
    monkeypatch.setattr(H, "CACHED_DISTANCES", 400)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (500, 3)).astype(float)
    groups = [rng.integers(-2, 3, (4, k, 3)).astype(float) for k in (2, 5)]
    groups[1][2, 4] = groups[1][2, 1]
    seen = [(len(rows), mine.size) for g in groups for rows, mine, _ in H._nearest_of(g, np.concatenate([x, np.ones((500, 1))], axis=1))]
    assert max(n for _, n in seen) <= 400 and sum(n for n, _ in seen) == 1000
    batches = [pa.RecordBatch.from_arrays([pa.array(list(p))], ["x"]) for p in (x[:300], x[300:])]
    got = next(H._lloyd_sums(groups)(iter(batches))).to_pylist()
    for g, r in zip(groups, got):
        apart = ((x[None, :, None] - g[:, None]) ** 2).sum(axis=3)
        near = apart.argmin(axis=2)[:, :, None] == np.arange(g.shape[1])
        assert np.array(r["counts"]).reshape(g.shape[:2]).tolist() == near.sum(axis=1).tolist() and r["costs"] == pytest.approx(apart.min(axis=2).sum(axis=1))
        assert np.array(r["sums"]).reshape(g.shape) == pytest.approx(np.einsum("rnk,nd->rkd", near.astype(float), x))
