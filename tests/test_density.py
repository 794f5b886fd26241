"""Grid density clustering against brute force, on every path."""

import random

import pytest

from ledgerlens.operators import density as H
from ledgerlens.operators.graph import connected_components


def brute(points, eps, m):
    """Neighbours by all pairs; clusters in order of the smallest core key."""
    keys = sorted(points)
    near = {k: [j for j in keys if sum((a - b) * (a - b) for a, b in zip(points[k], points[j])) <= eps * eps] for k in keys}
    core = {k for k in keys if len(near[k]) >= m}
    label = {}
    for k in keys:
        if k in core and k not in label:
            todo = [k]
            while todo:
                c = todo.pop()
                for j in near[c]:
                    if j not in label:
                        label[j] = k
                        if j in core:
                            todo.append(j)
    return {k: label.get(k) for k in keys}


def blobs(rnd, d, n):
    centres = [[rnd.uniform(-6, 6) for _ in range(d)] for _ in range(5)]
    out = {i: tuple(rnd.gauss(c, 0.5) for c in rnd.choice(centres)) for i in range(n)}
    for i in range(n, n + n // 5):
        out[i] = tuple(rnd.uniform(-8, 8) for _ in range(d))
    hot = tuple(float(x) for x in centres[0])
    for i in range(2 * n, 2 * n + n // 3):  # one point many times
        out[i] = hot
    for i in range(3 * n, 3 * n + 20):  # exact distances on a lattice
        out[i] = (10.0 + i % 5, *[10.0 + i // 5 % 4] * (d - 1))
    return out


def labelled(spark, points, d, eps, ms):
    df = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "k long, x array<double>")
    got = {(r.eps, r.min_points): {} for r in ()}
    for r in H.density_labels(df, "k", "x", d, eps, ms).collect():
        got.setdefault((r.eps, r.min_points), {})[r.k] = r.cluster
    return got


@pytest.mark.parametrize("d,few", [(2, 256), (2, 1), (3, 4)])
def test_equals_brute_force(spark, monkeypatch, d, few):
    monkeypatch.setattr(H, "FEW", few)
    points = blobs(random.Random(d), d, 150)
    eps, ms = [0.4, 1.0], [3, 5, 40]
    got = labelled(spark, points, d, eps, ms)
    assert got == {(e, m): brute(points, e, m) for e in eps for m in ms}
    assert any(len(set(v.values())) > 3 for v in got.values())


def test_crowded_cells_are_not_paired_point_by_point(spark, monkeypatch):
    """Two crowded cells, apart and near: boxes and their parts settle them."""
    rnd = random.Random(1)
    a = [(rnd.random() * 0.5, rnd.random() * 0.5) for _ in range(700)]
    b = [(1.02 + rnd.random() * 0.5, rnd.random() * 0.5) for _ in range(700)]
    points = dict(enumerate([*a, *b]))
    got = labelled(spark, points, 2, [0.5, 0.8], [5])
    assert {k: len(set(v.values())) for k, v in got.items()} == {k: len(set(brute(points, k[0], 5).values())) for k in got}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, -0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [None, 0.0]), (7, [1.0])],
                               "k long, x array<double>")
    got = {r.k: r.cluster for r in H.density_labels(df, "k", "x", 2, [1.0], [2]).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert H.density_labels(df.limit(0), "k", "x", 2, [1.0], [2]).collect() == []
    with pytest.raises(ValueError):
        H.density_labels(df, "k", "x", 4)


def test_settings_and_best(spark):
    rnd = random.Random(3)
    points = {i: (rnd.gauss(i % 2 * 9, 0.3), rnd.gauss(0, 0.3)) for i in range(120)}
    df = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "k long, features array<double>")
    labels = H.density_labels(df, "k", "features", 2, [0.01, 1.0, 20.0], [5])
    rows = {r.eps: r for r in H.density_settings(labels, df, "k").collect()}
    assert [rows[e].status for e in (0.01, 1.0, 20.0)] == ["rejected_too_few_clusters", "evaluated", "rejected_too_few_clusters"]
    assert rows[1.0].n_clusters == 2 and rows[1.0].silhouette_sq > 0.9 and rows[0.01].noise_ratio == 1.0 and rows[0.01].silhouette_sq == -1.0
    few = H.density_settings(labels, df, "k", least=500)
    assert few.where("status = 'rejected_too_much_noise'").count() == 1 and H.best_setting(few).count() == 0
    assert H.best_setting(H.density_settings(labels, df, "k")).first().eps == 1.0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n)}, n + 1: n + 1, n + 2: n + 1}
