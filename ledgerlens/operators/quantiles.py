"""Exact grouped quantiles without gathering a group in one task.

Spark's exact ``percentile``/``median`` merges every distinct value of a group
into one buffer on one task; with a group holding a third of the data that is
unbounded. Here the k-th order statistics are found by radix selection:

1. every value is mapped to a 64-bit integer of the same order (``sortable``):
   sign, exponent and mantissa, so that infinities, zeros and subnormals are
   ordinary values;
2. each wanted rank keeps a prefix of such integers and the count of values
   below it; every round counts the values that have the prefix by their next
   ten bits (one grouped count, map-side combined: at most groups x ranks x
   1024 rows), and the bucket that holds the rank is the next prefix. Bits in
   which no group's least and largest value differ are skipped. There are seven
   rounds at most, for any values;
3. a rank is settled when its bucket holds one distinct value, or few enough
   values (``settle_rows``) to rank them with a window function.

Values equal to each other have one integer, so a hot value settles at once.
-0.0 counts as 0.0. Interpolation is the linear rule of ``percentile`` /
``quantile_cont``: ``v[floor(pos)] + (pos - floor(pos)) * (v[ceil(pos)] -
v[floor(pos)])`` with ``pos = p * (n - 1)``; where both ends are equal, as
with infinities, it is that value.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored

#: Bits of the integers that a round tells apart.
DIGIT = 10
SETTLE_ROWS = 50_000
BROADCAST_STATE_ROWS = 200_000
_settle = ContextVar("settle_rows", default=SETTLE_ROWS)


@contextmanager
def settling(rows: int):
    """Within this block a window settles at ``rows`` values (tests and the
    ``*_by_rounds`` queries take a few, so that small tables need rounds too)."""
    token = _settle.set(rows)
    try:
        yield
    finally:
        _settle.reset(token)


def sortable(value: Column) -> Column:
    """A long that orders as the double ``value`` does (no null or NaN): the
    exponent above 52 bits of mantissa, mirrored for negative values. The
    exponent comes from a logarithm and is put right by exact powers of two."""
    size = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0))
    e = F.when(power(near) > size, near - 1).when((near < 1023) & (power(near + 1) <= size), near + 1).otherwise(near)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((size / power(e) - 1) * F.lit(2.0 ** 52)).cast("long")
    half = F.lit(2.0 ** 537)
    key = (F.when(size < F.lit(2.0 ** -1022), (size * half * half).cast("long"))  # a multiple of the least double
           .when(size == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(normal))
    return F.when(value < 0, -key).otherwise(key)


def _long_values(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), (F.col(c).cast("double") + 0.0).alias("_v")) for c in cols]))
    return (df.select(*by, stack.alias("_s"))
            .select(*by, "_s._c", "_s._v")
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))


def value_ranges(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., _n, _vmin, _vmax) of (keys..., _v), written once."""
    return cut_lineage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_vmin"), F.max("_v").alias("_vmax")))


def select_ranks(values: DataFrame, keys: Sequence[str], ranks: DataFrame, ranges: DataFrame | None = None,
                 settle_rows: int | None = None) -> DataFrame:
    """Order statistics by radix selection.

    ``values``: (keys..., _v) doubles, neither null nor NaN; they are read once
    a round and should come from a stored table. ``ranks``: (keys..., _r) with
    0-based ranks. ``ranges``: their ``value_ranges``. Returns (keys..., _r,
    _val): the ``_r``-th smallest ``_v`` of each group.

    When every group holds at most ``settle_rows`` values, one window per
    group ranks them directly (lazy plan, no state). Otherwise rounds narrow
    each rank's prefix first, seven at most."""
    keys = list(keys)
    settle_rows = _settle.get() if settle_rows is None else settle_rows
    if not keys:  # one global group: a constant key keeps the joins equi-joins
        one = lambda df: None if df is None else df.withColumn("_g", F.lit(0))
        return select_ranks(one(values), ["_g"], one(ranks), one(ranges), settle_rows).drop("_g")
    ranges = value_ranges(values, keys) if ranges is None else ranges
    ranges = ranges.select(*keys, F.col("_n").alias("_cnt"), sortable(F.col("_vmin")).alias("_kmin"), sortable(F.col("_vmax")).alias("_kmax"))
    differ = F.length(F.bin(F.col("_kmin").bitwiseXOR(F.col("_kmax"))))  # the highest bit in which a group's values differ
    found = ranges.agg(F.max("_cnt").alias("n"), F.max(F.when(F.col("_cnt") > settle_rows, differ)).alias("bits")).first()
    if (found["n"] or 0) <= settle_rows:
        rw = Window.partitionBy(*keys).orderBy("_v")
        ranked = values.withColumn("_r", (F.row_number().over(rw) - 1).cast("long"))
        return ranked.join(ranks.select(*keys, "_r"), keys + ["_r"], "left_semi").select(
            *keys, "_r", F.col("_v").alias("_val"))

    keyed = values.withColumn("_k", sortable(F.col("_v")))
    shifts = [*range(max(0, found["bits"] - DIGIT), 0, -DIGIT), 0]

    def prefix(key: str, bits: int) -> Column:
        """What all but the last ``bits`` bits of a key are."""
        return F.lit(0).cast("long") if bits >= 64 else F.shiftright(key, bits)

    # one prefix for all values of a group at first
    state = cut_lineage(ranks.join(ranges, keys).select(
        *keys, "_r", prefix("_kmin", shifts[0] + DIGIT).alias("_p"), F.lit(0).cast("long").alias("_below"), "_cnt",
        F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi")))
    for before, shift in zip([shifts[0] + DIGIT, *shifts], shifts):
        open_ = state.where((F.col("_cnt") > settle_rows) & (F.col("_lo").isNull() | (F.col("_lo") < F.col("_hi"))))
        # ranks of a group that share a prefix share its histogram
        windows = open_.select(*keys, "_p", "_below").distinct()
        n_open = windows.count()
        if n_open == 0:
            break
        probe = F.broadcast(windows) if n_open <= BROADCAST_STATE_ROWS else windows
        hist = (keyed.withColumn("_p", prefix("_k", before)).join(probe, keys + ["_p"])
                .groupBy(*keys, "_p", "_below", F.shiftright("_k", shift).alias("_b"))
                .agg(F.count(F.lit(1)).alias("_bc"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
        w = Window.partitionBy(*keys, "_p").orderBy("_b")
        hist = (hist.withColumn("_cum", F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("_start", F.col("_below") + F.col("_cum") - F.col("_bc")))
        chosen = (open_.select(*keys, "_r", "_p").join(hist.drop("_below"), keys + ["_p"])
                  .where((F.col("_start") <= F.col("_r")) & (F.col("_r") < F.col("_start") + F.col("_bc")))
                  .select(*keys, "_r", F.col("_b").alias("_p"), F.col("_start").alias("_below"), F.col("_bc").alias("_cnt"),
                          F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi")))
        state = cut_lineage(state.join(open_.select(*keys, "_r"), keys + ["_r"], "left_anti").unionByName(chosen))

    # Buckets of one distinct value are settled; the rest hold at most
    # ``settle_rows`` values each and are ranked directly.
    one = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi"))
    single = state.where(one).select(*keys, "_r", F.col("_lo").alias("_val"))
    whole = F.col("_lo").isNull()
    inside = whole | F.col("_v").between(F.col("_lo"), F.col("_hi"))
    rw = Window.partitionBy(*keys, "_r").orderBy("_v")
    ranked = (values.join(state.where(~one), keys).where(inside)
              .withColumn("_rn", F.row_number().over(rw) - 1 + F.col("_below"))
              .where(F.col("_rn") == F.col("_r"))
              .select(*keys, "_r", F.col("_v").alias("_val")))
    return cut_lineage(single.unionByName(ranked))


def kth_smallest(df: DataFrame, value: str, rank: F.Column, by: Sequence[str] = (),
                 name: str = "kth") -> DataFrame:
    """Per group, the value at 0-based ``rank`` (an expression over the group
    size ``_n``, e.g. ``F.ceil(F.col("_n") * 0.15) - 1``). Groups whose rank
    falls outside 0.._n-1 get null. Result: (by..., name)."""
    by = list(by)
    values = stored(df.select(*by, (F.col(value).cast("double") + 0.0).alias("_v")).where("_v is not null and not isnan(_v)"), "quantile-input")
    stats = value_ranges(values, by)
    ranks = stats.withColumn("_r", rank.cast("long"))
    ok = ranks.where((F.col("_r") >= 0) & (F.col("_r") < F.col("_n")))
    solved = select_ranks(values, by, ok.select(*by, "_r"), stats)
    if by:
        return stats.select(*by).join(solved.select(*by, F.col("_val").alias(name)), by, "left")
    return solved.agg(F.max(F.col("_val")).alias(name))


def grouped_quantiles(df: DataFrame, spec: Mapping[str, tuple[str, float]],
                      by: Sequence[str] = (), method: str = "exact",
                      accuracy: int = 10_000, settle_rows: int | None = None) -> DataFrame:
    """Quantiles per group. ``spec`` maps output name -> (column, p).

    Returns one row per group (``by`` columns + one column per spec entry).
    ``method="approx"`` uses ``percentile_approx`` (one pass, bounded memory,
    rank error about 1/accuracy)."""
    by = list(by)
    if method == "approx":
        return df.groupBy(*by).agg(*[
            F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(name)
            for name, (c, p) in spec.items()])
    if method != "exact":
        raise ValueError(method)

    spark = df.sparkSession
    cols = sorted({c for c, _ in spec.values()})
    # the wide columns are written once; every round reads them, in rows only while it counts
    df = stored(df.select(*dict.fromkeys([*by, *cols])), "quantile-input")
    values = _long_values(df, by, cols)
    keys = by + ["_c"]
    stats = value_ranges(values, keys)
    wanted = spark.createDataFrame([(name, c, float(p)) for name, (c, p) in spec.items()],
                                   "_name string, _c string, _p double")
    # spec is a literal list of a few entries: broadcast is size-bounded.
    targets = (stats.join(F.broadcast(wanted), "_c")
               .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
               .withColumn("_r_lo", F.floor("_pos"))
               .withColumn("_r_hi", F.ceil("_pos")))
    ranks = (targets.select(*keys, F.col("_r_lo").alias("_r"))
             .unionByName(targets.select(*keys, F.col("_r_hi").alias("_r")))
             .dropDuplicates(keys + ["_r"]))
    solved = select_ranks(values, keys, ranks, stats, settle_rows)

    lo = solved.select(*keys, F.col("_r").alias("_r_lo"), F.col("_val").alias("_v_lo"))
    hi = solved.select(*keys, F.col("_r").alias("_r_hi"), F.col("_val").alias("_v_hi"))
    q = (targets.join(lo, keys + ["_r_lo"]).join(hi, keys + ["_r_hi"])
         .select(*by, "_name",
                 F.when(F.col("_v_lo") == F.col("_v_hi"), F.col("_v_lo"))
                 .otherwise(F.col("_v_lo") + (F.col("_pos") - F.col("_r_lo")) * (F.col("_v_hi") - F.col("_v_lo")))
                 .alias("_q")))
    out = q.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name)
                               for name in spec])
    if by:
        # Groups whose columns are all null get null quantiles, as in pandas.
        out = df.select(*by).distinct().join(out, by, "left")
    # (without groups, the global aggregate above always yields one row)
    # The result is small (groups x outputs) and is often read by several
    # scalar subqueries: write it once to the checkpoint folder.
    return cut_lineage(out)


#: Accuracy of the sketch that ``column_quantiles`` takes first, and the share of ranks that it keeps on each side of a wanted one.
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 3e-4


def column_quantiles(df: DataFrame, spec: Mapping[str, tuple[str, float]]) -> dict[str, float | None]:
    """The row that ``grouped_quantiles`` gives without groups, as a dict. Of
    columns with more than ``settle_rows`` values a sketch takes, in one pass, two
    values that enclose the wanted rank; a second pass counts what is below
    them, and only the values between them become rows and are ranked. Should a
    rank not lie between its two values, all are ranked."""
    cols = sorted({c for c, _ in spec.values()})
    df = stored(df.select(*cols), "quantile-input")
    names = list(spec)
    x = {c: F.col(c).cast("double") + 0.0 for c in cols}
    x = {c: F.when(~F.isnan(v), v) for c, v in x.items()}

    def near(c: str, p: float) -> Column:
        return F.percentile_approx(x[c], [max(p - SKETCH_MARGIN, 0.0), min(p + SKETCH_MARGIN, 1.0)], SKETCH_ACCURACY)

    found = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, (c, _) in enumerate(spec.values())], *[near(c, p).alias(f"q{i}") for i, (c, p) in enumerate(spec.values())]).first()
    sizes = [found[f"n{i}"] for i in range(len(names))]
    if max(sizes, default=0) <= _settle.get():
        return grouped_quantiles(df, spec).first().asDict()
    # a sketch's ends are near the least and the largest value, not at them
    ends = [None if q is None else (q[0] if p > SKETCH_MARGIN else float("-inf"), q[1] if p < 1 - SKETCH_MARGIN else float("inf"))
            for q, (_, p) in zip((found[f"q{i}"] for i in range(len(names))), spec.values())]
    inside = {i: x[spec[names[i]][0]].between(*e) for i, e in enumerate(ends) if e is not None}
    counts = df.agg(*[F.count_if(x[spec[names[i]][0]] < ends[i][0]).alias(f"b{i}") for i in inside], *[F.count_if(v).alias(f"m{i}") for i, v in inside.items()]).first()
    place = {i: spec[names[i]][1] * (sizes[i] - 1) for i in inside}
    ranks = {i: (math.floor(at), math.ceil(at)) for i, at in place.items()}
    if not all(counts[f"b{i}"] <= lo and hi < counts[f"b{i}"] + counts[f"m{i}"] for i, (lo, hi) in ranks.items()):
        return grouped_quantiles(df, spec).first().asDict()
    values = {(i, r): ends[i][0] for i, rs in ranks.items() for r in rs if ends[i][0] == ends[i][1]}
    rest = [i for i in inside if ends[i][0] < ends[i][1]]
    if rest:
        any_inside = functools.reduce(lambda a, b: a | b, [F.coalesce(inside[i], F.lit(False)) for i in rest])
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.when(inside[i], x[spec[names[i]][0]]).alias("_v")) for i in rest]))
        between = stored(df.where(any_inside).select(each.alias("_s")).select("_s.*").where("_v is not null"), "quantile-values")
        wanted = df.sparkSession.createDataFrame([(i, r - counts[f"b{i}"]) for i in rest for r in sorted({*ranks[i]})], "_c int, _r long")
        values |= {(r["_c"], r["_r"] + counts[f"b{r['_c']}"]): r["_val"] for r in select_ranks(between, ["_c"], wanted).collect()}

    def at(i: int) -> float | None:
        if i not in inside:
            return None
        lo, hi = (values[i, r] for r in ranks[i])
        return lo if lo == hi else lo + (place[i] - ranks[i][0]) * (hi - lo)

    return {name: at(i) for i, name in enumerate(names)}


def quantile(df: DataFrame, col: str, p: float, by: Sequence[str] = (), name: str | None = None,
             method: str = "exact") -> DataFrame:
    name = name or f"q_{col}"
    return grouped_quantiles(df, {name: (col, p)}, by, method)
