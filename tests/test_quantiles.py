"""The distributed exact selection against numpy, on both code paths (direct
ranking and multi-round bucket narrowing)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quantiles
from ledgerlens.operators.quantiles import grouped_quantiles, kth_smallest, settling, sortable


def _frame(spark, values, groups):
    return spark.createDataFrame([(int(g), float(v) if v is not None else None) for g, v in zip(groups, values)],
                                 "g int, x double")


@pytest.mark.parametrize("settle", [10_000, 7])
def test_grouped_quantiles_match_numpy(spark, settle):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=300), np.full(200, 2.5), rng.exponential(size=100) * 1e6])
    groups = rng.integers(0, 3, size=vals.size)
    df = _frame(spark, vals, groups)
    spec = {"q10": ("x", 0.1), "med": ("x", 0.5), "q75": ("x", 0.75), "mx": ("x", 1.0)}
    out = {r["g"]: r for r in grouped_quantiles(df, spec, ["g"], settle_rows=settle).collect()}
    for g in range(3):
        sel = vals[groups == g]
        for name, (_, p) in spec.items():
            assert out[g][name] == pytest.approx(float(np.quantile(sel, p)), rel=1e-12, abs=1e-12)


def test_global_median_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 1000.0), (1, None), (1, 2000.0)], "g int, x double")
    assert grouped_quantiles(df, {"m": ("x", 0.5)}).first()["m"] == 1500.0


def test_hot_value_settles(spark):
    # a third of the rows share one value: its bucket has a single distinct value
    vals = [5.0] * 400 + list(range(800))
    df = _frame(spark, vals, [0] * len(vals))
    out = grouped_quantiles(df, {"m": ("x", 0.5)}, settle_rows=5).first()["m"]
    assert out == float(np.median(vals))


def test_kth_smallest(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"))
    assert kth_smallest(df, "x", F.lit(41)).first()[0] == 41.0


EDGES = [float("-inf"), -1.7976931348623157e308, -1e308, -2.0, -1.0000000000000002, -1.0, -2.2250738585072014e-308, -1e-310, -5e-324, -0.0, 0.0, 5e-324, 1e-323,
         2.2250738585072009e-308, 2.2250738585072014e-308, 1e-300, 0.1, 0.49999999999999994, 0.5, 1.0, 1.0000000000000002, 3.0, 4.0, 1e15, 2.0 ** 53, 1e308, 1.7976931348623157e308, float("inf")]


def test_integers_order_as_the_doubles(spark):
    rng = np.random.default_rng(1)
    more = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64).view(np.float64)
    vals = [*EDGES, *[v for e in range(-1074, 1024, 7) for v in (2.0 ** e, -np.nextafter(2.0 ** e, 0), np.nextafter(2.0 ** e, 9e307))], *more[~np.isnan(more)].tolist()]
    got = spark.createDataFrame([(float(v),) for v in vals], "x double").select("x", sortable(F.col("x")).alias("k")).collect()
    got.sort(key=lambda r: r.k)
    xs = [r.x for r in got]
    assert xs == sorted(xs)
    assert all((a.k == b.k) == (a.x == b.x) for a, b in zip(got, got[1:]))


def test_infinities_end_in_seven_rounds(spark, monkeypatch):
    rounds = []
    cut = quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    vals = EDGES * 3 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    finite = sorted(v for v in vals if v is not None and v == v)
    with settling(3):
        out = grouped_quantiles(df, {f"q{i}": ("x", i / (len(finite) - 1)) for i in range(0, len(finite), 4)}).first()
    assert [out[f"q{i}"] for i in range(0, len(finite), 4)] == [finite[i] for i in range(0, len(finite), 4)]
    assert len(rounds) <= 7 + 4  # the ranges, the first state, the solved ranks and the result besides the rounds


def test_all_groups_of_one_value_and_of_infinity(spark):
    df = _frame(spark, [float("inf")] * 9 + [2.0] * 9 + [float("-inf")] * 4 + [float("inf")] * 5, [0] * 9 + [1] * 9 + [2] * 9)
    with settling(2):
        got = {r["g"]: r["m"] for r in grouped_quantiles(df, {"m": ("x", 0.5)}, ["g"]).collect()}
    assert got == {0: float("inf"), 1: 2.0, 2: float("inf")}
