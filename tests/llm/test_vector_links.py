import numpy as np
import pytest

from ledgerlens.llm import vector_links as V

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, kept string"


def brute(rows, threshold=0.93):
    units = {}
    for k, (_, v, label, *_rest) in enumerate(rows):
        if label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        a = np.array(np.array(v, np.float32), np.float64)
        if np.abs(a).max() > 0:
            units[k] = (label, len(v), a / np.sqrt((a * a).sum()))
    near = {k: [j for j in units if j != k and units[j][:2] == units[k][:2] and float(units[j][2] @ units[k][2]) >= threshold] for k in units}
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for k in near:
            for j in near[k]:
                m = min(root[k], root[j])
                if root[k] != m or root[j] != m:
                    root[k] = root[j] = m
                    changed = True
    least = {}
    for k in range(len(rows)):
        least[root[k]] = min(least.get(root[k], rows[k][0]), rows[k][0])
    return sorted((r[0], len(near.get(k, [])), least[root[k]], r[0] == least[root[k]]) for k, r in enumerate(rows))


def vectors(n_groups=40, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n_groups):
        c = rng.standard_normal(dim)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 9))):
            rows.append([len(rows), (c + 0.2 * rng.standard_normal(dim)).tolist(), label])
    same = rows[0][1]
    rows += [[len(rows) + i, same, rows[0][2]] for i in range(30)]
    rows += [[len(rows) + i, [x * 2 for x in same], rows[0][2]] for i in range(3)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), same[:5]]
    rows += [[len(rows) + i, v, rows[0][2]] for i, v in enumerate(odd)]
    rows += [[len(rows), same, None], [len(rows) + 1, same, 77], [len(rows) + 2, [3e38] * dim, 1], [len(rows) + 3, [-0.0] * (dim - 1) + [1.0], 1], [len(rows) + 4, [0.0] * (dim - 1) + [1.0], 1]]
    return [tuple(r) + ("x", "y") for r in rows]


@pytest.mark.parametrize("block", [V.BLOCK, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = vectors()
    got = V.link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), recall=0.99999)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_recall(spark):
    rows = vectors(200, 64, 4)
    got = {r[0]: r for r in V.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert all(got[v][1] <= n for v, n, _, _ in want)
    assert sum(got[v][1] for v, *_ in want) >= 0.9 * sum(n for _, n, _, _ in want)


def test_collision_formula():
    rng = np.random.default_rng(0)
    for c in (0.3, 1.4):
        x, b = rng.standard_normal(200_000) * c, rng.uniform(0, V.WIDTH, 200_000)
        assert abs((np.floor((x + b) / V.WIDTH) == np.floor(b / V.WIDTH)).mean() - V.agreement(c)) < 0.01


def test_empty_and_repeated_ids(spark):
    assert V.link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 0.0], 0, "", ""), (1, [1.0, 0.0], 0, "", ""), (None, [1.0, 0.01], 0, "", ""), (None, None, None, None, None)]
    got = sorted(map(str, (tuple(r) for r in V.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)]))
