"""Daily summaries: merged, saved again, exact while small and bounded beyond."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import binary_metrics as M
from ledgerlens.operators import sketches as K


def rows(spark, n=4000):
    rng = np.random.default_rng(2)
    day = rng.integers(0, 10, n)
    x = rng.normal(size=n) + (day >= 5) * 0.8
    return spark.createDataFrame([(int(d), float(v), "ab"[int(v > 0)], float(1 / (1 + np.exp(-v))), int(rng.random() < 1 / (1 + np.exp(-2 * v))))
                                  for d, v in zip(day, x)], "day int, x double, c string, s double, y int")


def psi(ref, cur, cuts):
    edges = [-np.inf, *sorted(set(cuts)), np.inf]
    share = lambda v: np.maximum([((v > a) & (v <= b)).mean() for a, b in zip(edges, edges[1:])], 1e-6)
    p, q = share(ref), share(cur)
    return float(((q - p) * np.log(q / p)).sum())


def window(df, first):
    return np.array([r.x for r in df.where((F.col("day") < 5) == first).collect()])


@pytest.mark.parametrize("k", [8192, 64])
def test_psi_within_its_bound(spark, tmp_path, k):
    df, folder = rows(spark), f"file://{tmp_path}/s"
    K.save_days(df, folder, F.col("day"), ["x"], ["c"], k=k)
    got = {r.feature: r for r in K.psi_from_sketches(spark, folder, F.col("day") < 5, F.col("day") >= 5, k=k).collect()}
    ref, cur = window(df, True), window(df, False)
    cuts = K.merged_values(spark, folder, F.col("day") < 5).select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in K.DECILES]))).first()[0]
    want = psi(ref, cur, cuts)
    assert (got["x"].psi_error == 0) == (k > 4000) and abs(got["x"].psi - want) <= got["x"].psi_error + 1e-9
    if k > 4000:
        n = len(ref)
        assert cuts == [float(np.sort(ref)[int(np.ceil(p * n - 1e-9)) - 1]) for p in K.DECILES]
    assert got["c"].psi_error == 0 and got["c"].alert == (got["c"].psi > 0.2)


def test_a_day_saved_again_replaces_itself_only(spark, tmp_path):
    df, folder = rows(spark, 900), f"file://{tmp_path}/s"
    for d in (3, 1, 2):  # days arrive one by one, in any order
        K.save_days(df.where(F.col("day") == d), folder, F.col("day"), ["x"], ["c"], "s", "y")
    K.save_days(df.where(F.col("day") == 2).limit(10), folder, F.col("day"), ["x"], ["c"], "s", "y")
    n = {r.day: r.n for r in spark.read.parquet(f"{folder}/values").collect()}
    assert n == {1: df.where("day = 1").count(), 2: 10, 3: df.where("day = 3").count()}
    assert spark.read.parquet(f"{folder}/scores").agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == sum(n.values())


@pytest.mark.parametrize("levels", [20, None])
def test_quality_from_bins(spark, tmp_path, levels):
    df, folder = rows(spark), f"file://{tmp_path}/s"
    if levels:
        df = df.withColumn("s", F.floor(F.col("s") * levels) / levels)
    K.save_days(df, folder, F.col("day"), score="s", label="y")
    got = {r.period: r for r in K.quality_from_sketches(spark, folder, F.floor(F.col("day") / 5).cast("int"), 0.5).collect()}
    for p in (0, 1):
        part = df.where(F.floor(F.col("day") / 5) == p)
        m = M.classification_metrics(part, 0.5, "s", "y").first()
        assert got[p].recall == pytest.approx(m.recall) and got[p].precision == pytest.approx(m.precision)
        assert got[p].pr_auc_low - 1e-12 <= m.pr_auc <= got[p].pr_auc_high + 1e-12 and got[p].pr_auc_low <= got[p].pr_auc <= got[p].pr_auc_high
        if levels:
            assert got[p].pr_auc == pytest.approx(m.pr_auc)
        else:
            assert got[p].pr_auc_high - got[p].pr_auc_low < 0.02
    with pytest.raises(ValueError):
        K.quality_from_sketches(spark, folder, F.lit(0), 0.12345)


def test_odd_values(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1, 1.0, "a", 0.5, 1), (1, None, None, None, 0), (1, float("nan"), "a", 2.0, 1), (None, 3.0, "a", 0.5, 1), (2, float("inf"), "b", 1.0, 0), (2, 0.0, "b", 0.0, None)],
                               "day int, x double, c string, s double, y int")
    K.save_days(df, folder, F.col("day"), ["x"], ["c"], "s", "y")
    assert {r.day: r.n for r in spark.read.parquet(f"{folder}/values").collect()} == {1: 1, 2: 2}
    assert sorted((r.day, r.bin, r.pos, r.neg) for r in spark.read.parquet(f"{folder}/scores").collect()) == [(1, 500, 1, 0), (2, 1000, 0, 1)]


def corners(score, y):
    """All points of the walk, and those at which it turns."""
    pts, tp, fp = [], 0, 0
    for s in sorted(set(score), reverse=True):
        dp, dn = int(((score == s) & (y == 1)).sum()), int(((score == s) & (y != 1)).sum())
        tp, fp = tp + dp, fp + dn
        pts.append((float(s), tp, fp, dp, dn))
    kept = [a for a, b in zip(pts, [*pts[1:], None]) if b is None or a[3] * b[4] != b[3] * a[4]]
    return pts, kept


def area(points):
    xs, ys = [0, *[p[2] for p in points]], [0, *[p[1] for p in points]]
    return sum((b - a) * (c + d) / 2 for a, b, c, d in zip(xs, xs[1:], ys, ys[1:])) / (xs[-1] * ys[-1])


def test_corners_keep_the_area(spark, monkeypatch):
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 500, 3000) / 500, rng.integers(0, 2, 3000)
    y[score > 0.7], y[score < 0.2] = 1, 0  # long straight stretches, over chunk borders
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "proba double, y int")
    pts, kept = corners(score, y)
    got = M.curve_corners(df).collect()
    roc = sorted(((r.threshold, r.tp, r.fp) for r in got if r.on_roc), reverse=True)
    assert roc == [p[:3] for p in kept] and len(kept) < len(pts) - 100
    assert area(roc) == pytest.approx(area(pts), abs=1e-12)
    pr = sorted((r.threshold, r.tp, r.fp) for r in got if r.on_pr)
    ap = lambda p: sum((b[1] - a[1]) * b[1] / (b[1] + b[2]) for a, b in zip([(9, 0, 0), *p], p))
    assert ap(sorted(pr, reverse=True)) == pytest.approx(ap(pts))
    few = sorted(((r.threshold, r.tp, r.fp) for r in M.curve_corners(df, steps=10).collect() if r.on_roc), reverse=True)
    assert len(few) <= 11 and abs(area(few) - area(pts)) <= 0.2 and few[-1][1:] == roc[-1][1:]
