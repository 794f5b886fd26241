"""Density clustering (inventory H4) by a grid, for many settings at once.

Points have two or three coordinates (principal axes, for instance). Cells have
side eps / sqrt(d), so the points of one cell lie within eps of each other, and
points within eps lie in cells that are at most two apart:

* a cell of at least ``min_points`` points holds core points only; the others
  count their neighbours in the cells around;
* the core points of one cell are one cluster, and two cells belong together if
  two of their core points lie within eps. Cells are linked, not points, and
  clusters are the connected components of cells;
* a point that is no core point joins the neighbouring core point's cluster
  with the smallest key, or is noise.

Whether two sets of points come within eps is settled by their boxes where
these are far apart or wholly near. Sets of few points are compared point by
point; a larger one is cut in eight along each axis of its box and its parts
are tried again. So points meet only in adjacent cells, and a crowded cell is
never paired with another one point by point."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .clustering import cluster_metrics
from .graph import connected_components

# The settings of the grid, the least number of clustered points and the statuses.
DENSITY_EPS = [0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0]
DENSITY_POINTS = [5, 10, 15, 20]
DENSITY_LEAST = 50
FEW_CLUSTERS, MUCH_NOISE, EVALUATED = "rejected_too_few_clusters", "rejected_too_much_noise", "evaluated"

#: Pairs of points of two sets that are compared one by one.
FEW = 256
PARTS = 8


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cells that may hold a point within eps of one in the middle cell."""
    every = itertools.product(range(-2, 3), repeat=d)
    return [o for o in every if any(o) and sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _near2(alo, ahi, blo, bhi) -> Column:
    """Square of the least distance of two boxes."""
    gap = F.zip_with(F.zip_with(blo, ahi, lambda x, y: x - y), F.zip_with(alo, bhi, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return _sum(F.transform(gap, lambda g: g * g))


def _far2(alo, ahi, blo, bhi) -> Column:
    """Square of the largest distance of two boxes."""
    gap = F.zip_with(F.zip_with(bhi, alo, lambda x, y: x - y), F.zip_with(ahi, blo, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return _sum(F.transform(gap, lambda g: g * g))


def _boxes(df: DataFrame, by: Sequence[str], d: int, x: str = "x", *more: Column) -> DataFrame:
    """(by..., n, lo, hi, more...): size and box of every set."""
    ends = [f(F.col(x)[i]).alias(f"_{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *ends, *more)
    kept = [c for c in got.columns if not c.startswith(("_lo", "_hi"))]
    return got.select(*kept, F.array(*[F.col(f"_lo{i}") for i in range(d)]).alias("lo"), F.array(*[F.col(f"_hi{i}") for i in range(d)]).alias("hi"))


def _parts(sets: DataFrame, members: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Each set cut along its box: (id, part, n, lo, hi) and the parts' members."""
    cut = F.zip_with(F.zip_with("x", "lo", lambda x, lo: x - lo), F.zip_with("hi", "lo", lambda hi, lo: hi - lo),
                     lambda x, w: F.when(w > 0, F.least(F.floor(x / w * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0).cast("long")))
    placed = members.join(sets.select("id", "lo", "hi").distinct(), "id").select("id", "x", cut.alias("_cut"))
    found = stored(_boxes(placed, ["id", "_cut"], d).withColumn("part", F.monotonically_increasing_id()), "density-parts")
    inside = placed.join(found.select("id", "_cut", "part"), ["id", "_cut"]).select(F.col("part").alias("id"), "x")
    return found.drop("_cut"), stored(inside, "density-members")


def within(pairs: DataFrame, d: int, left: DataFrame | None, right: DataFrame, exists: bool) -> DataFrame:
    """(a, b, n): how many pairs of points of the sets a and b lie within eps;
    pairs of sets without any are left out. With ``exists`` n is 1.

    ``pairs``: a, b, eps, and of either side n and the box: an, alo, ahi, bn,
    blo, bhi. ``left`` and ``right``: (id, x), the sets' points; a left side of
    None has sets of one point."""
    state = pairs.select("*", F.col("a").alias("l"), F.col("b").alias("r"))
    eps2 = F.col("eps") * F.col("eps")
    near, far = _near2(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi")), _far2(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi"))
    found = []
    while True:
        open_ = F.when(far <= eps2, "all").when(near > eps2, "none").when(F.col("an") * F.col("bn") <= FEW, "few").otherwise("many")
        state = stored(state.withColumn("_is", open_).where("_is <> 'none'"), "density-pairs")
        hits = state.where("_is = 'all'").select("a", "b", (F.col("an") * F.col("bn")).alias("n"))
        few = state.where("_is = 'few'")
        for side, members in (("a", left), ("b", right)):
            short, lo, hi = {"a": "l", "b": "r"}[side], f"{side}lo", f"{side}hi"
            point = F.col(lo) == F.col(hi)  # one point, maybe several times
            rows = few.where(point).withColumns({f"x{side}": F.col(lo), f"w{side}": F.col(f"{side}n")})
            if members is not None:
                of = members.select(F.col("id").alias(short), F.col("x").alias(f"x{side}"))
                rows = rows.unionByName(few.where(~point).join(of, short).withColumn(f"w{side}", F.lit(1).cast("long")).select(*rows.columns))
            few = rows
        apart = _sum(F.transform(F.zip_with("xa", "xb", lambda x, y: x - y), lambda v: v * v))
        hits = hits.unionByName(few.where(apart <= eps2).select("a", "b", (F.col("wa") * F.col("wb")).alias("n")))
        found.append(hits)
        many = state.where("_is = 'many'").drop("_is")
        if exists:  # a pair of sets is settled by one hit
            many = many.join(hits.select("a", "b").distinct(), ["a", "b"], "left_anti")
        many = stored(many, "density-pairs")
        if many.isEmpty():
            break
        state = many
        for side, short in (("a", "l"), ("b", "r")):
            members = left if side == "a" else right
            if members is None:
                continue
            n, lo, hi = f"{side}n", f"{side}lo", f"{side}hi"
            point = F.col(lo) == F.col(hi)
            sets = many.where(~point).select(F.col(short).alias("id"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
            parts, inside = _parts(sets, members, d)
            parts = parts.select(F.col("id").alias(short), F.col("part").alias("_part"), F.col("n").alias(f"_{n}"), F.col("lo").alias(f"_{lo}"), F.col("hi").alias(f"_{hi}"))
            cut = (state.where(~point).join(parts, short).drop(short, n, lo, hi)
                   .withColumnsRenamed({"_part": short, f"_{n}": n, f"_{lo}": lo, f"_{hi}": hi}))
            state = state.where(point).unionByName(cut.select(*state.columns))
            if side == "a":
                left = inside
            else:
                right = inside
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("a", "b").agg((F.lit(1).cast("long") if exists else F.sum("n")).alias("n"))


def density_labels(points: DataFrame, key: str, axes: str, d: int, eps: Sequence[float] = DENSITY_EPS,
                   min_points: Sequence[int] = DENSITY_POINTS) -> DataFrame:
    """(eps, min_points, key, cluster) of every point and setting; cluster is
    the smallest key of the cluster's core points, null for noise.

    ``axes`` is an array of ``d`` coordinates, two or three. A point has itself
    as a neighbour; distances up to eps count. Rows with a null, NaN or
    infinite coordinate are noise in every setting. Keys are unique."""
    if d not in (2, 3):
        raise ValueError("two or three axes")
    spark = points.sparkSession
    ms = sorted(min_points)
    x = F.transform(axes, lambda v: v.cast("double") + 0.0)
    good = F.coalesce((F.size(axes) == d) & F.forall(axes, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    points = stored(points.select(F.col(key).alias("key"), F.when(good, x).alias("x")), "density-points")
    grid = spark.createDataFrame([(float(e), i, m) for e in eps for i, m in enumerate(ms, 1)], "eps double, level int, min_points int")
    side = F.col("eps") / math.sqrt(d) * (1 - 1e-9)
    # a literal list of distances
    spread = (points.where("x is not null").select("key", "x", F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps"))
              .withColumn("cell", F.transform("x", lambda v: F.floor(v / side))))
    cells = stored(_boxes(spread, ["eps", "cell"], d).withColumn("cid", F.monotonically_increasing_id()), "density-cells")
    around = F.explode(F.array(*[F.array(*[F.lit(i).cast("long") for i in o]) for o in _offsets(d)]))

    def moved(df: DataFrame) -> DataFrame:
        """With the cells around each row's cell in ``cell``."""
        return df.withColumn("_o", around).withColumn("cell", F.zip_with("cell", "_o", lambda c, o: c + o)).drop("_o")

    placed = spread.join(cells.select("eps", "cell", "cid", F.col("n").alias("own")), ["eps", "cell"])
    members = placed.select(F.col("cid").alias("id"), "x")
    sparse = stored(placed.where(F.col("own") < ms[-1]).withColumn("a", F.monotonically_increasing_id()), "density-sparse")
    pairs = moved(sparse.select("a", "eps", "cell", "x")).join(cells, ["eps", "cell"]).select(
        "a", F.col("cid").alias("b"), "eps", F.lit(1).cast("long").alias("an"), F.col("x").alias("alo"), F.col("x").alias("ahi"),
        F.col("n").alias("bn"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    seen = within(pairs, d, None, members, False).groupBy("a").agg(F.sum("n").alias("_n"))
    level = sum(((F.col("own") + F.coalesce("_n", F.lit(0)) >= m).cast("int") for m in ms), F.lit(0))
    known = sparse.join(seen, "a", "left").select("eps", "cid", "cell", "key", "x", level.alias("level"))
    crowded = placed.where(F.col("own") >= ms[-1]).select("eps", "cid", "cell", "key", "x", F.lit(len(ms)).alias("level"))
    known = stored(known.unionByName(crowded), "density-levels")

    # the core points of a cell, by setting: those of its level and above
    of_level = _boxes(known.where("level > 0"), ["eps", "cid", "cell", "level"], d, "x", F.min("key").alias("first"))
    of_level = of_level.withColumn("level", F.explode(F.sequence(F.lit(1), "level")))
    least = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(d)]).alias(c)
    core = of_level.groupBy("eps", "cid", "cell", "level").agg(F.sum("n").alias("n"), least("lo", F.min), least("hi", F.max), F.min("first").alias("first"))
    core = stored(core.withColumn("sid", F.monotonically_increasing_id()), "density-core")
    core_members = (known.where("level > 0").withColumn("level", F.explode(F.sequence(F.lit(1), "level")))
                    .join(core.select("cid", "level", "sid"), ["cid", "level"]).select(F.col("sid").alias("id"), "x"))
    box = lambda s: [F.col("sid").alias(s), F.col("n").alias(f"{s}n"), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")]
    links = (moved(core.select("eps", "level", "cell", *box("a"))).join(core.select("eps", "level", "cell", *box("b")), ["eps", "level", "cell"])
             .where("a < b").select("a", "b", "eps", "an", "alo", "ahi", "bn", "blo", "bhi"))
    edges = within(links, d, core_members, core_members, True)
    roots = connected_components(edges, "a", "b").select(F.col("node").alias("sid"), "root")
    core = core.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = core.groupBy("root").agg(F.min("first").alias("cluster"))
    core = stored(core.join(names, "root"), "density-clusters")

    of_core = (known.where("level > 0").withColumn("level", F.explode(F.sequence(F.lit(1), "level")))
               .join(core.select("cid", "level", "cluster"), ["cid", "level"]).select("eps", "level", "key", "cluster"))
    rest = known.where(F.col("level") < len(ms)).withColumn("level", F.explode(F.sequence(F.col("level") + 1, F.lit(len(ms)))))
    rest = stored(rest.withColumn("a", F.monotonically_increasing_id()), "density-rest")
    mine = rest.join(core.select("cid", "level", F.col("sid").alias("b")), ["cid", "level"]).select("a", "b")  # a core point in the own cell
    pairs = moved(rest.select("a", "eps", "level", "cell", "x")).join(core, ["eps", "level", "cell"]).select(
        "a", F.col("sid").alias("b"), "eps", F.lit(1).cast("long").alias("an"), F.col("x").alias("alo"), F.col("x").alias("ahi"),
        F.col("n").alias("bn"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    touched = within(pairs, d, None, core_members, True).select("a", "b").unionByName(mine)
    joined = touched.join(core.select(F.col("sid").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    of_rest = rest.join(joined, "a", "left").select("eps", "level", "key", "cluster")
    settings = F.array(*[F.struct(F.lit(float(e)).alias("eps"), F.lit(i).alias("level")) for e in eps for i in range(1, len(ms) + 1)])
    lost = (points.where("x is null").select("key", F.explode(settings).alias("_s"))
            .select("_s.eps", "_s.level", "key", F.lit(None).cast(points.schema["key"].dataType).alias("cluster")))
    every = of_core.unionByName(of_rest).unionByName(lost)
    return every.join(F.broadcast(grid), ["eps", "level"]).select("eps", "min_points", F.col("key").alias(key), "cluster")


def density_settings(labels: DataFrame, vectors: DataFrame, key: str, features: str = "features", least: int = DENSITY_LEAST) -> DataFrame:
    """Every setting's clusters, noise ratio, status and measures (H6-H8) on
    the points that are not noise. A setting of under two clusters or under
    ``least`` clustered points is rejected, with -1 / inf / 0."""
    counts = labels.groupBy("eps", "min_points").agg(
        F.count_distinct("cluster").cast("int").alias("n_clusters"), F.count("cluster").alias("clustered"), F.count_if(F.col("cluster").isNull()).alias("noise"))
    status = F.when(F.col("n_clusters") < 2, FEW_CLUSTERS).when(F.col("clustered") < least, MUCH_NOISE).otherwise(EVALUATED)
    counts = stored(counts.withColumn("status", status), "density-counts")
    # a row a setting
    fit = F.broadcast(counts.where(F.col("status") == EVALUATED).select("eps", "min_points"))
    scored = labels.where("cluster is not null").join(fit, ["eps", "min_points"]).join(vectors.select(key, features), key)
    m = cluster_metrics(scored, features, "cluster", by=["eps", "min_points"]).drop("n_clusters")
    return (counts.join(m, ["eps", "min_points"], "left")
            .select("eps", "min_points", "n_clusters", "clustered", "noise", (F.col("noise") / (F.col("noise") + F.col("clustered"))).alias("noise_ratio"), "status",
                    F.coalesce("silhouette_sq", F.lit(-1.0)).alias("silhouette_sq"), F.coalesce("davies_bouldin", F.lit(float("inf"))).alias("davies_bouldin"),
                    F.coalesce("calinski_harabasz", F.lit(0.0)).alias("calinski_harabasz")))


def best_setting(settings: DataFrame, db_weight: float = 0.05) -> DataFrame:
    """H9's separate density best: the evaluated setting of the highest
    ``silhouette - 0.05 * Davies-Bouldin``; the first in order of eps and
    min_points on a tie. Without an evaluated setting there is no row."""
    score = F.col("silhouette_sq") - F.lit(db_weight) * F.col("davies_bouldin")
    return settings.where(F.col("status") == EVALUATED).withColumn("selection_score", score).orderBy(F.desc("selection_score"), "eps", "min_points").limit(1)
