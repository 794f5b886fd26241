from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mix_sources as M

from .helpers import documents, empty, words


def test_targets_share_and_cap():
    got = M.targets([("a", 100), ("b", 10), ("c", 100)])
    assert sum(got) == 210 and got[1] == 30
    assert got[0] == Fraction(180, 4) and got[2] == Fraction(3 * 180, 4)
    assert M.targets([]) == [] and M.targets([("a", 0)]) == [0]


def brute_targets(sizes):
    total, w = sum(sizes), [(i % 3) + 1 for i in range(len(sizes))]
    t = [total * x / sum(w) for x in w]
    for _ in range(200):
        over = [i for i in range(len(t)) if t[i] > 3 * sizes[i] + 1e-9]
        if not over:
            break
        capped = [i for i in range(len(t)) if t[i] >= 3 * sizes[i] - 1e-9]
        excess = sum(t[i] - 3 * sizes[i] for i in over)
        for i in over:
            t[i] = 3 * sizes[i]
        free = [i for i in range(len(t)) if i not in capped]
        for i in free:
            t[i] += excess * w[i] / sum(w[j] for j in free)
    return t


@pytest.mark.parametrize("sizes", [[5, 5, 5, 100], [1, 2, 3, 4, 5, 6], [1000, 1, 1, 1], [7]])
def test_targets_against_repeated_sharing(sizes):
    got = M.targets([(str(i), s) for i, s in enumerate(sizes)])
    assert [float(x) for x in got] == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), ["s1", "s0", None, "s2"][i % 4 if i % 3 else 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = M.mix(df).collect()
    assert sorted(got) == sorted(M.mix(df.repartition(3)).collect())
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        x = by[source[r.doc_id]]
        x[0] += r.size
        x[1], x[2] = r.source_size, r.target
        x[3] += r.taken
    order = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][2] for s in order] == pytest.approx(brute_targets([by[s][0] for s in order]))
    for s in order:
        assert by[s][0] == by[s][1] and abs(by[s][3] - by[s][2]) <= 90


def test_long_documents_are_drawn_less(spark):
    """A document of over the long share has a smaller chance than others."""
    rows = [(i, "w " * (2000 if i % 100 == 0 else 10), "a" if i < 1000 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(list)
    for seed in range(3):
        for r in M.mix(df, seed=seed).where(F.col("doc_id") < 1000).collect():
            taken[r.size].append(r.copies)
    assert sum(taken[2000]) / len(taken[2000]) < sum(taken[10]) / len(taken[10])


def test_inclusion_grows_with_size(spark):
    """Four times the words, twice the chance; equal chances with a power of 0. Sources stay on target."""
    rows = [(i, "w " * (80 if i % 2 else 20), "abc"[i % 6 // 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for power, ratio in ((0.5, 2.0), (0.0, 1.0)):
        taken = defaultdict(list)
        for seed in range(2):
            got = M.mix(df, seed=seed, size_power=power).where("doc_id % 6 < 2").collect()
            assert abs(sum(r.taken for r in got) - got[0].target) <= 40
            for r in got:
                taken[r.size].append(r.copies)
        assert sum(taken[80]) / sum(taken[20]) == pytest.approx(ratio, rel=0.15)


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    got = M.mix(df).collect()
    assert len(got) == df.count()
    assert all(r.taken <= 3 * r.size and (r.size or r.taken == 0) for r in got)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    want = sorted(str(r.doc_id) for r in got for _ in range(r.copies))
    assert sorted(str(r.doc_id) for r in mixed.select("doc_id").collect()) == want


def test_empty(spark):
    assert M.mix(empty(spark)).collect() == [] and M.mixed_documents(empty(spark)).collect() == []


def test_no_python_on_the_executors(spark):
    plan = M.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
