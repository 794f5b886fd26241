"""Clustering quality and model fitting (inventory H1-H10).

Quality measures are computed in O(n * k * d) from per-cluster sufficient
statistics (size, sum vector, sum of squared norms), never from point pairs:

* ``silhouette_sq``: the silhouette with squared Euclidean distance (the form
  Spark's ``ClusteringEvaluator`` uses). For squared distances the mean
  distance from a point to a cluster is ``|x|^2 - 2 x.S/n + Q/n``, so each
  row needs only the k cluster sums. The Euclidean silhouette is in
  ``silhouette``, with an error bound.
* Davies-Bouldin: mean distance to the own centroid per cluster and the k x k
  centroid distances, computed inside one row holding the k centroids.
* Calinski-Harabasz: between- and within-cluster sums of squares.

The per-cluster table has (models x k) rows of d numbers; it reaches each
row as a broadcast join on the model key, with its size checked first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import stored

MAX_BROADCAST_CELLS = 2_000_000  # models x k x d doubles allowed in the broadcast stats


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def cluster_stats(df: DataFrame, features: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cluster, n, sums array, sumsq): one row per cluster, from one
    grouped vector summary (map-side combined, one buffer of d sums a cluster)."""
    x = F.col(features)
    sums = vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(features)).getField("sum"))
    return df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(_dot(x, x)).alias("sumsq"), sums.alias("sums"))


def _batch_sums(stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """For every model and cluster the sums over a partition's rows of distance
    and squared distance to the own centre and of the silhouette."""
    first = np.cumsum([0, *(len(n) for n, _, _ in stats)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, first[-1]))
        for batch in batches:
            model, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for m in np.unique(model):
                n, sums, sumsq = stats[m]
                of = model == m
                rows, mine = x[of], own[of]
                at = np.arange(len(rows))
                count = np.tile(n, (len(rows), 1))
                count[at, mine] -= 1
                with np.errstate(all="ignore"):
                    apart = (n * (rows ** 2).sum(axis=1)[:, None] - 2 * (rows @ sums.T) + sumsq) / count
                    a = apart[at, mine].copy()
                    apart[at, mine] = np.nan
                    b = np.fmin.reduce(apart, axis=1)
                    top = np.maximum(a, b)
                    s = np.where(n[mine] <= 1, 0.0, (b - a) / top)
                there = (n[mine] <= 1) | (top != 0) if len(n) > 1 else n[mine] <= 1
                square = ((rows - sums[mine] / n[mine][:, None]) ** 2).sum(axis=1)
                for i, v in enumerate((np.ones(len(rows)), np.sqrt(square), square, np.where(there, s, 0.0), there.astype(float))):
                    total[i, first[m]:first[m + 1]] += np.bincount(mine, v, len(n))
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(t[at]) for t in total)], ["_at", "rows", "far", "square", "s", "s_rows"])

    return run


def _point_sums(data: DataFrame, features: str, cluster: str, key: Sequence[str], models: list, stats: DataFrame) -> DataFrame:
    """(key..., _own, spread, wss, s_sum): the mean distance to the own centre, the
    sum of its square and of the silhouettes, of every cluster. ``models`` has
    each model's statistics, bounded by ``MAX_BROADCAST_CELLS``."""
    packs = [(np.array([c["n"] for c in m["cl"]], float), np.array([c["sums"] for c in m["cl"]], float), np.array([c["sumsq"] for c in m["cl"]], float)) for m in models]
    first = np.cumsum([0, *(len(m["cl"]) for m in models)])
    kinds = {f.name: f for f in stats.schema.fields}
    names = StructType([*(kinds[c] for c in key), StructField("_own", kinds[cluster].dataType), *(StructField(c, IntegerType()) for c in ("_model", "_cluster", "_at"))])
    places = F.broadcast(data.sparkSession.createDataFrame(
        [(*(m[c] for c in key), c_["k"], i, j, int(first[i] + j)) for i, m in enumerate(models) for j, c_ in enumerate(m["cl"])], names))  # a row a cluster
    rows = data.withColumn("_own", F.col(cluster)).join(places, [*key, "_own"]).select("_model", "_cluster", F.col(features).alias("_x"))
    sums = rows.mapInArrow(_batch_sums(packs), "_at int, rows double, far double, square double, s double, s_rows double")
    sums = sums.groupBy("_at").agg(*[F.sum(c).alias(c) for c in ("rows", "far", "square", "s", "s_rows")])
    return sums.join(places, "_at").select(*key, "_own", (F.col("far") / F.col("rows")).alias("spread"), F.col("square").alias("wss"),
                                           F.when(F.col("s_rows") > 0, F.col("s")).alias("s_sum"))


def _point_sums_by_columns(data: DataFrame, features: str, cluster: str, key: Sequence[str], packed: DataFrame) -> DataFrame:
    """As ``_point_sums``, by column expressions: for statistics of more than
    ``MAX_BROADCAST_CELLS`` numbers, and with a null among the names."""
    x = F.col(features)
    own = F.col(cluster)
    xx = _dot(x, x)
    # mean squared distance from the row to every cluster
    means = F.transform(F.col("cl"), lambda c: F.struct(
        c["k"].alias("k"), c["n"].alias("n"),
        F.try_divide(c["n"] * xx - 2 * _dot(x, c["sums"]) + c["sumsq"],
                     F.when(c["k"] == own, c["n"] - 1).otherwise(c["n"]).cast("double")).alias("d")))
    rows = data.join(packed, key).select(*key, own.alias("_own"), means.alias("_m2"), "n_clusters",
                                           "cl", x.alias("_x"))
    a = F.filter("_m2", lambda m: m["k"] == F.col("_own"))[0]
    b = F.array_min(F.transform(F.filter("_m2", lambda m: m["k"] != F.col("_own")), lambda m: m["d"]))
    s = F.when(a["n"] <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a["d"], F.greatest(a["d"], b)))
    centroid = F.transform(F.filter("cl", lambda c: c["k"] == F.col("_own"))[0]["sums"],
                           lambda v: v / a["n"])
    per_row = rows.select(*key, "_own", s.alias("_s"),
                          F.sqrt(_sqdist(F.col("_x"), centroid)).alias("_dist"),
                          _sqdist(F.col("_x"), centroid).alias("_sq"))
    return per_row.groupBy(*key, "_own").agg(F.avg("_dist").alias("spread"), F.sum("_sq").alias("wss"),
                                              F.sum("_s").alias("s_sum"))


def cluster_metrics(df: DataFrame, features: str = "features", cluster: str = "cluster",
                    by: Sequence[str] = ()) -> DataFrame:
    """H6-H8 per model (``by``): silhouette_sq, davies_bouldin,
    calinski_harabasz and n_clusters. A single cluster gives -1 / inf / 0."""
    by = list(by)
    key = by if by else ["_m"]
    data = df if by else df.withColumn("_m", F.lit(0))
    st = cluster_stats(data, features, cluster, key)
    packed = st.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("k"), "n", "sums", "sumsq"))).alias("cl"),
        F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_total"))
    packed = stored(packed, "cluster-stats")  # a row a model, read three times
    size = packed.agg(F.sum(F.col("n_clusters") * F.size(F.col("cl")[0]["sums"]))).first()[0] or 0
    models = packed.select(*key, "cl").collect() if size <= MAX_BROADCAST_CELLS else None
    if models is not None and all(m[c] is not None for m in models for c in key) and all(c["k"] is not None for m in models for c in m["cl"]):
        per_cluster = _point_sums(data, features, cluster, key, models, st)
    else:
        per_cluster = _point_sums_by_columns(data, features, cluster, key, packed)
    agg = per_cluster.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_own").alias("k"), "spread"))).alias("spreads"),
        F.sum("wss").alias("W"), F.sum("s_sum").alias("S"))
    # k x k on the centroid arrays of one model, inside one row
    cen = F.transform(F.col("cl"), lambda c: F.transform(c["sums"], lambda v: v / c["n"]))
    tot = F.aggregate(F.col("cl"), F.array_repeat(F.lit(0.0), F.size(F.col("cl")[0]["sums"])),
                      lambda acc, c: F.zip_with(acc, c["sums"], lambda p, q: p + q))
    grand = F.transform(tot, lambda v: v / F.col("n_total"))
    between = F.aggregate(F.zip_with(F.col("cl"), cen, lambda c, m: c["n"] * _sqdist(m, grand)),
                          F.lit(0.0), lambda acc, v: acc + v)
    idx = F.sequence(F.lit(0), F.size("cl") - 1)
    spread = lambda i: F.col("spreads")[i]["spread"]
    worst = F.transform(idx, lambda i: F.array_max(F.transform(
        F.filter(idx, lambda j: j != i),
        lambda j: F.try_divide(spread(i) + spread(j), F.sqrt(_sqdist(cen[i], cen[j]))))))
    db = F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / F.size("cl")
    k = F.col("n_clusters")
    n = F.col("n_total")
    out = agg.join(packed, key).select(
        *by,
        F.when(k <= 1, F.lit(-1.0)).otherwise(F.col("S") / n).alias("silhouette_sq"),
        F.when(k <= 1, F.lit(float("inf"))).otherwise(db).alias("davies_bouldin"),
        F.when(k <= 1, F.lit(0.0)).otherwise(
            F.try_divide(F.try_divide(between, (k - 1).cast("double")),
                         F.try_divide(F.col("W"), (n - k).cast("double")))).alias("calinski_harabasz"),
        k.cast("int").alias("n_clusters"))
    return out


def select_model(metrics: DataFrame, name: str = "model", db_weight: float = 0.05, without_predict: Sequence[str] = ("agglomerative", "density")) -> DataFrame:
    """H9: the model with the highest ``silhouette - 0.05 * davies_bouldin``
    (ties: first by name), by the Euclidean silhouette where the metrics hold
    it; one that can label new rows is preferred to those whose name starts as
    in ``without_predict``."""
    score = F.col("silhouette" if "silhouette" in metrics.columns else "silhouette_sq") - F.lit(db_weight) * F.col("davies_bouldin")
    predicts = F.lit(True)
    for w in without_predict:
        predicts = predicts & ~F.col(name).startswith(w)
    scored = metrics.withColumn("selection_score", score)
    best = scored.agg(F.min_by(F.col(name), F.struct(~predicts, -F.col("selection_score"), F.col(name)))).scalar()
    return scored.withColumn("is_selected", F.col(name) == best)


# -- MLlib fitting ------------------------------------------------------------

#: Rows that a partition of vectors holds at least; an iterative fit on few rows
#: costs as many tasks an iteration as it has partitions.
ROWS_PER_PARTITION = 50_000


def sized(vectors: DataFrame, n: int) -> DataFrame:
    """The vectors in at most one partition for every ``ROWS_PER_PARTITION``."""
    return vectors.coalesce(max(1, n // ROWS_PER_PARTITION + 1))


#: Rows that a task of a k-means iteration holds at least, while there are cores for more tasks.
ROWS_PER_TASK = 4_000


#: Squared distances that are in a core's cache at a time.
CACHED_DISTANCES = 1 << 17


def _nearest_of(centres: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For ``centres`` (runs, k, d) and rows ``x`` with a last column of ones, a
    few rows at a time: (rows, whether a centre is a run's nearest as (rows, k,
    runs), each run's squared distance without the row's own square); the smallest number
    on a tie."""
    runs, k, d = centres.shape
    flat = np.empty((d + 1, k, runs))  # products with it are distances but for the row's square
    flat[:d] = -2 * centres.transpose(2, 1, 0)
    flat[d] = (centres ** 2).sum(axis=2).T
    flat = flat.reshape(d + 1, -1)
    step = max(16, CACHED_DISTANCES // (k * runs))
    for i in range(0, len(x), step):
        rows = x[i:i + step]
        apart = (rows @ flat).reshape(len(rows), k, runs)
        least = apart.min(axis=1)
        mine = apart == least[:, None]
        if np.count_nonzero(mine) != least.size:
            mine = apart.argmin(axis=1)[:, None] == np.arange(k)[:, None]
        yield rows, mine, least


def _lloyd_sums(groups: list[np.ndarray]):
    """For every group of runs of one k, a partition's counts, sum vectors and
    cost by centre, as one row a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((c.shape[1] * c.shape[0], c.shape[2] + 1)) for c in groups]  # by centre, then run
        costs = [np.zeros(len(c)) for c in groups]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            squares = (x ** 2).sum(axis=1)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for g, centres in enumerate(groups):
                at = 0
                for rows, mine, least in _nearest_of(centres, x):
                    costs[g] += np.maximum(least + squares[at:at + len(rows), None], 0.0).sum(axis=0)
                    sums[g] += mine.reshape(len(rows), -1).astype(float).T @ rows
                    at += len(rows)
        whole = [s.reshape(c.shape[1], c.shape[0], -1).transpose(1, 0, 2) for s, c in zip(sums, groups)]
        flat = lambda parts: pa.array([p.ravel() for p in parts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(groups)), pa.int32()), flat([w[:, :, -1] for w in whole]), flat([w[:, :, :-1] for w in whole]), flat(costs)],
                                         ["g", "counts", "sums", "costs"])
    return run


def kmeans_costs(vectors: DataFrame, runs: Sequence[tuple[int, int]], features: str = "features", iters: int = 300, tol: float = 1e-4,
                 parallel: int = 8) -> list[float]:
    """The training cost of MLlib's k-means for each (k, seed) of ``runs``.

    The first centres are MLlib's own (k-means|| by seed). All runs then share
    each of Lloyd's iterations, which is one job for all of them: a run ends
    when none of its centres moves by more than ``tol``, as in MLlib. A task
    returns sums by centre, and runs x k x d numbers reach the driver."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans

    vectors = vectors.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    n = vectors.count()

    def first(run):
        model = KMeans(k=run[0], seed=run[1], featuresCol=features, maxIter=0).fit(vectors)
        return np.array(model.clusterCenters(), float)

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(runs)))) as pool:
        centres = list(pool.map(first, runs))
    x = vectors.select(vector_to_array(features).alias("x"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, n // ROWS_PER_TASK + 1)
    if x.rdd.getNumPartitions() < parts:
        x = x.repartition(parts)
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    costs, open_ = [0.0] * len(runs), set(range(len(runs)))
    for _ in range(iters):
        members: dict[int, list[int]] = {}
        for i in sorted(open_):
            members.setdefault(len(centres[i]), []).append(i)  # MLlib gives fewer centres than k to few distinct rows
        ids = list(members.values())
        groups = [np.array([centres[i] for i in of]) for of in ids]
        found = x.mapInArrow(_lloyd_sums(groups), "g int, counts array<double>, sums array<double>, costs array<double>")
        total = [[np.zeros(c.shape[:2]), np.zeros(c.shape), np.zeros(len(c))] for c in groups]
        for r in found.collect():
            for have, name in zip(total[r["g"]], ("counts", "sums", "costs")):
                have += np.array(r[name]).reshape(have.shape)
        for of, old, (count, sums, cost) in zip(ids, groups, total):
            new = np.where(count[:, :, None] > 0, sums / np.maximum(count, 1)[:, :, None], old)
            moved = ((new - old) ** 2).sum(axis=2).max(axis=1)
            for i, to, far, value in zip(of, new, moved, cost):
                centres[i], costs[i] = to, float(value)
                if far <= tol * tol:
                    open_.discard(i)
        if not open_:
            break
    x.unpersist()
    vectors.unpersist()
    return costs


def best_restarts(vectors: DataFrame, ks: Sequence[int], restarts: int = 20, seed: int = 42, features: str = "features") -> dict[int, tuple[int, float]]:
    """k -> (seed, training cost) of the restart of least cost; the lowest seed on a tie."""
    runs = [(int(k), seed + r) for k in ks for r in range(max(1, restarts))]
    costs = dict(zip(runs, kmeans_costs(vectors, runs, features)))
    return {int(k): min(((s, c) for (of, s), c in costs.items() if of == int(k)), key=lambda b: b[1]) for k in ks}


def fit_kmeans(vectors: DataFrame, k: int, restarts: int = 20, seed: int = 42, features: str = "features", best: int | None = None):
    """H1: k-means|| with ``restarts`` seeds, best training cost kept (lowest
    seed on a tie). The restarts run together (``kmeans_costs``); MLlib fits the
    model of the best one, or of the seed ``best`` where that is known."""
    from pyspark.ml.clustering import KMeans

    if best is None:
        best = best_restarts(vectors, [k], restarts, seed, features)[k][0] if restarts > 1 else seed
    return KMeans(k=k, seed=best, featuresCol=features, predictionCol="cluster", maxIter=300).fit(vectors)


def fit_gmm(vectors: DataFrame, k: int, seed: int = 42, features: str = "features"):
    """H2: Gaussian mixture (full covariance), hard label out."""
    from pyspark.ml.clustering import GaussianMixture
    return GaussianMixture(k=k, seed=seed, featuresCol=features, predictionCol="cluster",
                           probabilityCol="cluster_proba", maxIter=100).fit(vectors)


def elbow(vectors: DataFrame, ks: Sequence[int] = range(2, 11), restarts: int = 20, seed: int = 42,
          features: str = "features") -> DataFrame:
    """H5: within-cluster sum of squares per k, of the best restart; the
    restarts of every k run together."""
    best = best_restarts(vectors, ks, restarts, seed, features)
    return vectors.sparkSession.createDataFrame([(int(k), best[int(k)][1]) for k in ks], "k int, inertia double")


def pca_projection(vectors: DataFrame, k: int = 2, features: str = "features", keep: Sequence[str] = ()):
    """Principal components of the centred matrix (Spark's PCA does not
    centre on transform, so centre first) and explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features,
                             outputCol="_centred").fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_centred", outputCol="pcs").fit(centred)
    proj = model.transform(centred).select(*keep, vector_to_array("pcs").alias("_p"))
    proj = proj.select(*keep, *[F.col("_p")[i].alias(f"PC{i + 1}") for i in range(k)])
    return proj, list(model.explainedVariance.toArray())
