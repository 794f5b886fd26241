"""Model training, calibration and scoring with MLlib (inventory G3-G14).

Each configuration is fitted on the train split with a class-weight column,
calibrated on validation (F7) and measured on test (F1-F3); the best PR-AUC
wins (F13). Inputs are prepared with the exact ``Preparer`` (G1/G2), so
MLlib sees standardised numbers and one-hot categories; its own
``StandardScaler`` (sample std) and approximate ``Imputer`` are not used.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stored
from . import binary_metrics as M
from .boosting import fit_boosted
from .cleaning import CLUSTER_DROP_COLUMNS, FRAUD_ID_COLUMNS, basic_cleaning, drop_feature_columns, label_feature, preprocess_cluster, preprocess_fraud
from .clustering import fit_kmeans, sized
from .features import REFERENCE_YEAR, build_cluster_features, build_fraud_features
from .prep import Preparer, categorical_columns, numeric_columns
from .quantiles import grouped_quantiles


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(rows, positives) in one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return r["n"], r["p"]


def balanced_weights(n: int, positives: int) -> tuple[float, float]:
    """``n / (2 * n_class)`` (sklearn "balanced"), as (positive, negative)."""
    return n / (2 * max(positives, 1)), n / (2 * max(n - positives, 1))


def positive_weight(n: int, positives: int) -> tuple[float, float]:
    """G8 (boosting form): positives weigh ``max(neg / pos, 1)``."""
    return max((n - positives) / max(positives, 1), 1.0), 1.0


@dataclass
class ModelConfig:
    name: str
    build: Callable[[int], object]          # number of input features -> estimator
    weighting: Callable[[int, int], tuple[float, float]] | None = balanced_weights


def logistic_regression(n_rows_weight: float = 1.0) -> Callable[[int], object]:
    """L2 logistic regression. sklearn's C=1 on a weighted sum matches
    ``regParam = 1 / sum(weights)`` on Spark's weighted mean loss."""
    from pyspark.ml.classification import LogisticRegression

    def build(_d):
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_rows_weight, 1.0), elasticNetParam=0.0,
                                  standardization=False, weightCol="weight", featuresCol="features", labelCol="label")
    return build


def random_forest(trees: int = 300, seed: int = 42) -> Callable[[int], object]:
    """Bagged trees, class-balanced weights, sqrt feature subsets (depth
    is capped at 30 in MLlib)."""
    from pyspark.ml.classification import RandomForestClassifier
    return lambda _d: RandomForestClassifier(numTrees=trees, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed,
                                             weightCol="weight", featuresCol="features", labelCol="label",
                                             minInstancesPerNode=1, maxBins=64)


def boosted_trees(iters: int = 400, depth: int = 6, step: float = 0.08, subsample: float = 0.9,
                  seed: int = 42, bins: int = 32) -> Callable[[int], object]:
    """Gradient-boosted trees with weighted positives. G6's engine
    grows leaf by leaf to 31 leaves over 255 bins; five levels have 32. Rows find
    their node from the root: in trees of few levels that costs less than a
    cached table of node ids a level, and gives the same trees."""
    from pyspark.ml.classification import GBTClassifier
    return lambda _d: GBTClassifier(maxIter=iters, maxDepth=depth, stepSize=step, subsamplingRate=subsample, maxBins=bins,
                                    featureSubsetStrategy="0.9", seed=seed, weightCol="weight", featuresCol="features", labelCol="label")


#: A fit of a forest keeps a count of 4 bytes for each row and tree: so many for a core at most.
COUNTS_PER_CORE = 100_000_000


def fit_forest(est, df: DataFrame, n: int):
    """A forest over ``n`` rows as one model. Its trees don't depend on each
    other; where the counts of all rows and trees would grow past the executors'
    memory, some trees grow at a time, with seeds of their own."""
    from pyspark.ml.classification import RandomForestClassificationModel
    sc = df.sparkSession.sparkContext
    total = est.getNumTrees()
    some = max(1, COUNTS_PER_CORE * sc.defaultParallelism // max(n, 1))
    if some >= total:
        return est.fit(df)
    trees, model = [], None
    for i, start in enumerate(range(0, total, some)):
        model = est.copy({est.numTrees: min(some, total - start), est.seed: est.getSeed() + i * 1_000_003}).fit(df)
        trees += list(model._java_obj.trees())
    kinds = sc._jvm.org.apache.spark.ml.classification
    grown = sc._gateway.new_array(kinds.DecisionTreeClassificationModel, total)
    for i, t in enumerate(trees):
        grown[i] = t
    whole = kinds.RandomForestClassificationModel(model.uid, grown, model.numFeatures, model.numClasses)
    return est._copyValues(RandomForestClassificationModel(whole))


class EarlyStoppingPerceptron:
    """A perceptron fitted a few iterations at a time: every round goes on from
    the last one's weights, and the loss on rows kept apart decides which
    weights stay. Training ends after ``patience`` rounds that don't lower the
    loss by ``tol``, or after ``iters`` iterations."""

    def __init__(self, layers: Sequence[int], iters: int = 30, seed: int = 42, step: int = 2, patience: int = 5, tol: float = 1e-4, fraction: float = 0.1):
        self.layers, self.iters, self.seed = list(layers), iters, seed
        self.step, self.patience, self.tol, self.fraction = step, patience, tol, fraction
        self.losses: list[float] = []

    def fit(self, df: DataFrame):
        from pyspark.ml.classification import MultilayerPerceptronClassifier

        # equal rows go to the same side
        apart = F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(10_000)) < int(self.fraction * 10_000)
        train, held = df.where(~apart).persist(StorageLevel.MEMORY_AND_DISK), df.where(apart).persist(StorageLevel.MEMORY_AND_DISK)
        best = model = None
        least, waited = float("inf"), 0
        self.losses = []
        for start in range(0, self.iters, self.step):
            est = MultilayerPerceptronClassifier(layers=self.layers, maxIter=min(self.step, self.iters - start), seed=self.seed, featuresCol="features", labelCol="label")
            if model is not None:
                est.setInitialWeights(model.weights)
            model = est.fit(train)
            right = F.get(vector_to_array("probability"), F.col("label").cast("int"))
            loss = model.transform(held).agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15))))).first()[0]
            if loss is None:  # no rows kept apart: all iterations, the last weights
                best = model
                continue
            self.losses.append(loss)
            if loss < least - self.tol:
                best, least, waited = model, loss, 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
        train.unpersist()
        held.unpersist()
        return best if best is not None else model


def perceptron(hidden: Sequence[int] = (64, 32), iters: int = 30, seed: int = 42) -> Callable[[int], object]:
    """Feed-forward network (sigmoid hidden layers in MLlib) with early
    stopping on a tenth of the training rows."""
    return lambda d: EarlyStoppingPerceptron([d, *hidden, 2], iters, seed)


def fraud_design(df: DataFrame) -> DataFrame:
    """B2 + C1-C6 + B5: the model input table (keeps ``event_id``, label)."""
    f = build_fraud_features(preprocess_fraud(df, unique="event_id"))
    return drop_feature_columns(f, FRAUD_ID_COLUMNS)


def _save_preparation(prep: Preparer, path: str, meta: dict) -> None:
    """Parameters as one line of JSON, and the tables of categories beside it."""
    spark = SparkSession.getActiveSession()
    for i, (_, _, table) in enumerate(prep.tables.values()):
        spark.read.parquet(table).write.mode("overwrite").parquet(f"{path}/categories/{i}")
    line = json.dumps(meta | {"numeric": {k: list(v) for k, v in prep.numeric.items()}, "categorical": {k: [v[0], v[1]] for k, v in prep.categorical.items()},
                              "tables": {k: [v[0], v[1]] for k, v in prep.tables.items()}})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scoring")


def _load_preparation(path: str) -> tuple[Preparer, dict]:
    meta = json.loads(SparkSession.getActiveSession().read.text(f"{path}/scoring").first()[0])
    tables = {k: (v[0], v[1], f"{path}/categories/{i}") for i, (k, v) in enumerate(meta["tables"].items())}
    return Preparer({k: tuple(v) for k, v in meta["numeric"].items()}, {k: (v[0], v[1]) for k, v in meta["categorical"].items()}, tables), meta


def _load_fitted(path: str, name: str):
    module, cls = name.rsplit(".", 1)
    return getattr(importlib.import_module(module), cls).load(f"{path}/model")


@dataclass
class FittedModel:
    name: str
    prep: Preparer
    model: object
    threshold: float
    train_size: int = 0
    #: (key, y, split, proba) of the rows kept apart from training, a stored table; not saved with the model
    scores: DataFrame | None = None

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The input is aligned to the training columns (B6); out come
        the probability of the positive class and the alert flag."""
        vec = self.prep.to_vector(self.prep.aligned(df, keep), keep)
        out = self.model.transform(vec)
        proba = vector_to_array("probability")[1]
        return out.select(*keep, proba.alias("proba"),
                          (proba >= F.lit(self.threshold)).cast("int").alias("prediction"))

    def save(self, path: str) -> None:
        """The MLlib model and, beside it, what the scoring needs."""
        self.model.write().overwrite().save(f"{path}/model")
        _save_preparation(self.prep, path, {"name": self.name, "threshold": self.threshold, "train_size": self.train_size,
                                            "class": f"{type(self.model).__module__}.{type(self.model).__name__}"})

    @classmethod
    def load(cls, path: str) -> "FittedModel":
        prep, meta = _load_preparation(path)
        return cls(meta["name"], prep, _load_fitted(path, meta["class"]), meta["threshold"], meta["train_size"])


@dataclass
class SegmentModel:
    """A clustering with what scoring new customers needs: the training
    median, last date and year besides the preparation (G14)."""

    prep: Preparer
    model: object
    income_median: float | None
    reference_date: str | None
    reference_year: int = REFERENCE_YEAR

    @classmethod
    def fit(cls, customers: DataFrame, k: int = 4, restarts: int = 20, key: str = "ID") -> "SegmentModel":
        """From raw customer rows, which are read several times and should be
        stored: B3, C7-C13, B5, G1, G2 and H1."""
        clean = basic_cleaning(customers, unique=key)
        median = grouped_quantiles(clean, {"m": ("Income", 0.5)}).first()["m"] if "Income" in clean.columns else None
        last = clean.agg(F.max(F.try_to_timestamp("Dt_Customer", F.lit("dd/MM/yyyy")).cast("date"))).first()[0] if "Dt_Customer" in clean.columns else None
        out = cls(Preparer(), None, median, None if last is None else last.isoformat())
        c = stored(out.features(customers, key), "segment-input")
        x = c.drop(*CLUSTER_DROP_COLUMNS)
        out.prep = Preparer.fit(x, numeric_columns(x), categorical_columns(x))
        n = c.count()
        vec = sized(stored(sized(out.prep.to_vector(c, [key]), n), "segment-vectors"), n).persist(StorageLevel.MEMORY_AND_DISK)
        out.model = fit_kmeans(vec, k, restarts)
        vec.unpersist()
        return out

    def features(self, customers: DataFrame, key: str = "ID") -> DataFrame:
        """Cleaned rows and their features, by the training's parameters."""
        rows = preprocess_cluster(customers, F.lit(self.income_median).cast("double"), unique=key)
        return build_cluster_features(rows, self.reference_year, F.lit(self.reference_date).cast("date"))

    def score(self, customers: DataFrame, key: str = "ID") -> DataFrame:
        """(key, cluster) of raw customer rows; any subset gives each row the
        cluster that it has in the whole."""
        vec = self.prep.to_vector(self.prep.aligned(self.features(customers, key), [key]), [key])
        return self.model.transform(vec).select(key, "cluster")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _save_preparation(self.prep, path, {"income_median": self.income_median, "reference_date": self.reference_date, "reference_year": self.reference_year,
                                            "class": f"{type(self.model).__module__}.{type(self.model).__name__}"})

    @classmethod
    def load(cls, path: str) -> "SegmentModel":
        prep, meta = _load_preparation(path)
        return cls(prep, _load_fitted(path, meta["class"]), meta["income_median"], meta["reference_date"], meta["reference_year"])


def path_exists(spark, path: str) -> bool:
    """Whether a path exists, on any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_model(folder: str, best_name: str, generic: str = "model") -> FittedModel:
    """The folder of the best model's name if there is one, else the
    generic one; an error names both when neither is there."""
    spark = SparkSession.getActiveSession()
    for name in (best_name, generic):
        if path_exists(spark, f"{folder}/{name}/scoring"):
            return FittedModel.load(f"{folder}/{name}")
    raise FileNotFoundError(f"neither {best_name!r} nor {generic!r} in {folder}")


#: Rows that a partition of training vectors holds at least; small sets don't pay for many tasks an iteration.
ROWS_PER_PARTITION = 50_000
#: Rows that a partition holds at most; larger sets are dealt to equal partitions, as many for every core.
MOST_ROWS_PER_PARTITION = 1_000_000


def fit_preparation(split: DataFrame, label: str = "isFraud", key: str = "event_id") -> Preparer:
    """The preparation of the train rows, the same for every configuration."""
    feats = split.select(*[c for c in split.columns if c not in (label, key, "split")])
    return Preparer.fit(split.where(F.col("split") == "train"), numeric_columns(feats), categorical_columns(feats))


def train_and_evaluate(split: DataFrame, config: ModelConfig, label: str = "isFraud", key: str = "event_id",
                       min_recall: float = 0.75, prep: Preparer | None = None) -> tuple[FittedModel, DataFrame]:
    """G9 for one configuration: fit on train, calibrate on val, measure on
    test. ``split`` carries a ``split`` column (E2 or E4) and should be a
    stored table; the scores of val and test are stored once."""
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    train = split.where(F.col("split") == "train").withColumn("label", F.col(label).cast("double"))
    n, positives = class_counts(train, label)
    prep = prep or fit_preparation(split, label, key)
    keep_columns = ["label"]
    total = float(n)
    if config.weighting is not None:
        pos_w, neg_w = config.weighting(n, positives)
        train = train.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(pos_w))).otherwise(F.lit(float(neg_w))))
        keep_columns.append("weight")
        total = pos_w * positives + neg_w * (n - positives)
    cores = train.sparkSession.sparkContext.defaultParallelism
    many = n >= ROWS_PER_PARTITION * cores
    vec = prep.to_vector(train, keep_columns)
    # the learners keep their own form of the rows in memory: of many rows the vectors stay on disk
    vec = vec.repartition(cores * -(-n // (cores * MOST_ROWS_PER_PARTITION))).persist(StorageLevel.DISK_ONLY) if many else vec.coalesce(n // ROWS_PER_PARTITION + 1).persist(StorageLevel.MEMORY_AND_DISK)
    est = config.build(prep.n_outputs())
    if type(est).__name__ == "LogisticRegression":
        est = est.setRegParam(1.0 / max(total, 1.0))
    if type(est).__name__ == "RandomForestClassifier":
        model = fit_forest(est, vec, n)
    elif type(est).__name__ == "GBTClassifier" and many:
        model = fit_boosted(est, vec)
    else:
        model = est.fit(vec)
    vec.unpersist()
    fitted = FittedModel(config.name, prep, model, 0.5, n)

    held = split.where(F.col("split") != "train")
    scored = stored(fitted.score(held, [key, label, "split"]).withColumnRenamed(label, "y"), f"scores-{config.name}")
    fitted.scores = scored.drop("prediction")
    fitted.threshold = float(M.best_threshold(scored.where(F.col("split") == "val"), min_recall).first()["threshold"])
    metrics = M.classification_metrics(scored.where(F.col("split") == "test"), fitted.threshold)
    metrics = metrics.select(F.lit(config.name).alias("model"), "*", F.lit(fitted.threshold).alias("threshold"),
                             F.lit(n).cast("long").alias("train_size"), F.lit(sizes.get("val", 0)).cast("long").alias("val_size"),
                             F.lit(min_recall).alias("min_recall_constraint"))
    return fitted, stored(metrics, f"metrics-{config.name}")


#: Rows a core up to which two fits share the executors' memory; of more each goes alone.
ROWS_OF_TWO_FITS = 2_000_000


def fits_at_once(n: int, cores: int, most: int = 5) -> int:
    """Each learner keeps its own form of the rows, so fits of many rows don't all go together."""
    return most if n < ROWS_PER_PARTITION * cores else min(most, 2) if n <= ROWS_OF_TWO_FITS * cores else 1


def compare_models(split: DataFrame, configs: Sequence[ModelConfig], parallel: int = 5, **kw) -> tuple[list[FittedModel], DataFrame]:
    """G9 + F13: every configuration, then the best PR-AUC (first wins). The
    fits are independent Spark jobs on one preparation, submitted from at most
    ``parallel`` threads. Returns the fitted models, best first, and the metrics."""
    prep = fit_preparation(split, **{k: v for k, v in kw.items() if k in ("label", "key")})
    at_once = fits_at_once(split.count(), split.sparkSession.sparkContext.defaultParallelism, parallel)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        got = list(pool.map(lambda c: train_and_evaluate(split, c, prep=prep, **kw), configs))
    rows = None
    for i, (_, m) in enumerate(got):
        m = m.withColumn("_order", F.lit(i))
        rows = m if rows is None else rows.unionByName(m)
    order = [r["model"] for r in rows.orderBy(F.desc("pr_auc"), "_order").select("model").collect()]
    fitted = sorted((f for f, _ in got), key=lambda f: order.index(f.name))
    return fitted, rows.drop("_order").withColumn("is_best", F.col("model") == order[0])


def feature_importance(fitted: FittedModel, top: int = 15) -> DataFrame:
    """Importance per prepared feature of a tree model, or the size of a
    linear model's coefficients on standardised inputs; display names."""
    spark = SparkSession.getActiveSession()
    values = getattr(fitted.model, "featureImportances", None)
    if values is None:
        values = getattr(fitted.model, "coefficients", None)
    if values is None:
        raise ValueError(f"{fitted.name} has no importances")
    df = spark.createDataFrame(list(zip(fitted.prep.output_names(), [float(abs(v)) for v in values.toArray()])), "feature string, importance double")
    return (df.select(label_feature("feature").alias("feature"), "importance")
            .orderBy(F.desc("importance"), "feature").limit(top))


def _mean_contributions(rows: DataFrame, names: Sequence[str], contributions: Sequence[Column]) -> DataFrame:
    """(feature, mean_abs, mean) of one column a feature: sums of the columns as
    they are, of which only the one row of sums becomes a row a feature."""
    sums = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(contributions)
                      for k, f in (("_n", F.count), ("_a", lambda x: F.sum(F.abs(x))), ("_s", F.sum))], F.count(F.lit(1)).alias("_rows"))
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("a"), F.col(f"_s{i}").alias("s")) for i, n in enumerate(names)])
    return (sums.where("_rows > 0").select(F.explode(each).alias("_t")).groupBy(F.col("_t.feature").alias("feature"))
            .agg(F.try_divide(F.sum("_t.a"), F.sum("_t.n")).alias("mean_abs"), F.try_divide(F.sum("_t.s"), F.sum("_t.n")).alias("mean")))


def linear_contributions(fitted: FittedModel, df: DataFrame, key: str, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """G12 (linear explainer): contribution of feature j to a row's logit is
    ``coef_j * (x_j - mean_j)``; the prepared features are already centred,
    so it is ``coef_j * x_j``. Returns (global mean |contribution| and mean
    contribution per feature, top-``top`` features per row)."""
    coefs = fitted.model.coefficients.toArray().tolist()
    names = fitted.prep.output_names()
    wide = fitted.prep.transform(df, [key])
    # sorted by size, then name; a row's features never leave it
    contrib = F.sort_array(F.array(*[F.struct((-F.abs(F.col(f"`{n}`") * F.lit(c))).alias("size"), F.lit(n).alias("feature"),
                                              (F.col(f"`{n}`") * F.lit(c)).alias("c")) for n, c in zip(names, coefs)]))
    rows = wide.select(key, contrib.alias("_all"))
    glob = _mean_contributions(wide, names, [F.col(f"`{n}`") * F.lit(c) for n, c in zip(names, coefs)])
    per_row = (rows.select(key, F.posexplode(F.slice("_all", 1, top)).alias("_i", "_t"))
               .select(key, (F.col("_i") + 1).alias("rank"), "_t.feature", "_t.c"))
    return glob, per_row


def linear_totals(fitted: FittedModel, df: DataFrame, key: str) -> DataFrame:
    """(key, base, total): the intercept, and with it the sum of a row's contributions."""
    coefs = fitted.model.coefficients.toArray().tolist()
    wide = fitted.prep.transform(fitted.prep.aligned(df, [key]), [key])
    base = F.lit(float(fitted.model.intercept))
    total = base
    for n, c in zip(fitted.prep.output_names(), coefs):
        total = total + F.col(f"`{n}`") * F.lit(c)
    return wide.select(key, base.alias("base"), total.alias("total"))


def tree_nodes(fitted: FittedModel) -> DataFrame:
    """A tree model as a table: tree, id, feature (null in a leaf), threshold or
    categories that go left, children and the node's value. A value is what the
    node adds to the model's raw score: the boosting weight times its mean, or
    its share of positives over the number of trees."""
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "models", f"nodes-{uuid.uuid4().hex}")
    fitted.model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = [float(w) for w in fitted.model.treeWeights]
    if "GBT" in type(fitted.model).__name__:
        value = F.get(F.array(*[F.lit(w) for w in weights]), F.col("treeID")) * F.col("prediction")
    else:
        value = F.get("impurityStats", F.lit(1)) / F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x) / len(weights)
    leaf = F.col("leftChild") < 0
    by_set = F.col("split.numCategories") >= 0
    return n.select(F.col("treeID").alias("tree"), "id", F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
                    F.when(~leaf & ~by_set, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
                    F.when(~leaf & by_set, F.col("split.leftCategoriesOrThreshold")).alias("categories"),
                    F.when(~leaf, F.col("leftChild")).alias("left"), F.when(~leaf, F.col("rightChild")).alias("right"), value.alias("value"))


#: Numbers in the table of every node's contributions; larger models are followed step by step.
MOST_PATH_NUMBERS = 8_000_000


def _paths(nodes: list, place: dict, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray, n_features: int):
    """For each tree (first node, nodes, steps to its deepest leaf), of the nodes put
    tree by tree in preorder: feature, threshold, children and the contributions
    of the whole path from the root to each node. A leaf leads to itself."""
    trees, order, depth = [], [], np.zeros(len(nodes), int)
    paths = np.zeros((len(nodes), n_features))
    for t in sorted({t for t, _ in place}):
        open_, first = [place[t, 0]], len(order)
        while open_:
            i = open_.pop()
            order.append(i)
            if feature[i] >= 0:
                for c in child[i][::-1]:
                    paths[c] = paths[i]
                    paths[c, feature[i]] += value[c] - value[i]
                    depth[c] = depth[i] + 1
                    open_.append(c)
        trees.append((first, len(order) - first, max(depth[order[first:]])))
    order = np.array(order)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return trees, np.maximum(feature[order], 0), threshold[order], at[child[order]], paths[order]


def _walks(nodes: list, n_features: int):
    """Follows all trees for a batch of rows: each step from a node to its child
    gives the change of value to the feature that the node tests. A leaf
    has the sum of its path's steps, which a row gets at once."""
    place = {(r["tree"], r["id"]): i for i, r in enumerate(nodes)}
    feature = np.array([-1 if r["feature"] is None else r["feature"] for r in nodes])
    threshold = np.array([np.nan if r["threshold"] is None else r["threshold"] for r in nodes])
    child = np.array([[i, i] if r["left"] is None else [place[r["tree"], r["left"]], place[r["tree"], r["right"]]] for i, r in enumerate(nodes)])
    value = np.array([r["value"] for r in nodes])
    sets = {i: np.array(r["categories"]) for i, r in enumerate(nodes) if r["categories"] is not None}
    roots = np.array(sorted(place[t, 0] for t in {r["tree"] for r in nodes}))
    base = float(value[roots].sum())

    if not sets and len(nodes) * n_features <= MOST_PATH_NUMBERS:
        trees, tested, limit, following, paths = _paths(nodes, place, feature, threshold, child, value, n_features)

        def by_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, n = batch.column(0), batch.num_rows
                flat = np.ascontiguousarray(np.array(batch.column(1).flatten(), float).reshape(n, -1).T).ravel()
                out, row = np.zeros((n, n_features)), np.arange(n)
                for first, _, steps in trees:
                    node = np.full(n, first)
                    for _ in range(steps):
                        right = ~(flat[tested[node] * n + row] <= limit[node])
                        node = following[node, right.astype(np.int64)]
                    out += paths[node]
                of = pa.ListArray.from_arrays(np.arange(0, n * n_features + 1, n_features, dtype=np.int32), out.ravel())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(n, base)), of], ["_key", "base", "_c"])

        return by_tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rows = batch.column(0), np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            out = np.zeros((len(rows), n_features))
            step = max(1, (1 << 20) // len(roots))
            for a in range(0, len(rows), step):
                x = rows[a:a + step]
                at = np.tile(roots, (len(x), 1))
                row = np.repeat(np.arange(len(x)), len(roots)).reshape(at.shape)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    here, r, f = at[inner], row[inner], f[inner]
                    v = x[r, f]
                    left = v <= threshold[here]
                    for i in sets:
                        mine = here == i
                        left[mine] = np.isin(v[mine], sets[i])
                    there = child[here, np.where(left, 0, 1)]
                    out[a:a + step] += np.bincount(r * n_features + f, value[there] - value[here], len(x) * n_features).reshape(len(x), -1)
                    at[inner] = there
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(rows), base)), pa.array(list(out), pa.list_(pa.float64()))], ["_key", "base", "_c"])

    return run


def tree_contributions(fitted: FittedModel, df: DataFrame, key: str, top: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G12 (tree explainer): each step down a tree credits the tested feature
    with the change of the node's value, so a row's contributions and the base
    (the roots' values) sum to the model's raw score. Returns (global mean
    |contribution| and mean contribution per feature, top-``top`` features per
    row, (key, base, total) per row). The nodes, as the model itself, come
    through the driver."""
    names = fitted.prep.output_names()
    nodes = tree_nodes(fitted).collect()
    vec = fitted.prep.to_vector(fitted.prep.aligned(df, [key]), [key]).select(F.col(key).alias("_key"), vector_to_array("features").alias("_x"))
    kind = vec.schema["_key"].dataType.simpleString()
    rows = stored(vec.mapInArrow(_walks(nodes, len(names)), f"_key {kind}, base double, _c array<double>"), "contributions").withColumnRenamed("_key", key)
    named = F.zip_with("_c", F.array(*[F.lit(n) for n in names]), lambda c, n: F.struct((-F.abs(c)).alias("size"), n.alias("feature"), c.alias("c")))
    ranked = rows.select(key, F.sort_array(named).alias("_all"))
    glob = _mean_contributions(rows, names, [F.get("_c", F.lit(i)) for i in range(len(names))])
    per_row = (ranked.select(key, F.posexplode(F.slice("_all", 1, top)).alias("_i", "_t"))
               .select(key, (F.col("_i") + 1).alias("rank"), "_t.feature", "_t.c"))
    total = F.col("base") + F.aggregate("_c", F.lit(0.0), lambda a, x: a + x)
    return glob, per_row, rows.select(key, "base", total.alias("total"))


def linear_probability(prep: Preparer, coefficients: dict[str, float], intercept: float) -> Column:
    """G13 with stored coefficients: the logistic probability from a frame
    that ``prep.transform`` made, as one column expression."""
    z = F.lit(float(intercept))
    for name in prep.output_names():
        z = z + F.lit(float(coefficients.get(name, 0.0))) * F.col(f"`{name}`")
    return 1.0 / (1.0 + F.exp(-z))
