"""Clustering-quality queries over the vectors (V), plus MLlib model
training and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as H
from ..operators.density import DENSITY_EPS, DENSITY_LEAST, DENSITY_POINTS, best_setting, density_labels, density_settings
from ..operators.silhouette import silhouette
from ..operators.ward import fit_ward
from .catalog import V, r6, register

#: The reference's limit of the Euclidean silhouette.
SILHOUETTE_MIN = 0.10

# Four labelings of the same vectors, compared as if they were four models.
_LABELINGS_SQL = """
lab AS (SELECT vec_id, features, 'label10' model, cluster FROM v
        UNION ALL SELECT vec_id, features, 'mod5', cluster % 5 FROM v
        UNION ALL SELECT vec_id, features, 'mod2', cluster % 2 FROM v
        UNION ALL SELECT vec_id, features, 'single', 0 FROM v)"""


def labelings(spark, sf):
    v = V(spark, sf)
    return (v.select("vec_id", "features", F.lit("label10").alias("model"), "cluster")
            .unionByName(v.select("vec_id", "features", F.lit("mod5").alias("model"), (F.col("cluster") % 5).alias("cluster")))
            .unionByName(v.select("vec_id", "features", F.lit("mod2").alias("model"), (F.col("cluster") % 2).alias("cluster")))
            .unionByName(v.select("vec_id", "features", F.lit("single").alias("model"), F.lit(0).alias("cluster"))))


_MEASURES_SQL = """,
sizes AS (SELECT model, cluster, count(*) n FROM lab GROUP BY 1, 2),
pairs AS (SELECT a.model, a.vec_id i, a.cluster ci, b.cluster cj, avg(pow(list_distance(a.features, b.features), 2)) d
          FROM lab a JOIN lab b ON a.model = b.model AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
pt AS (SELECT model, i, ci, max(CASE WHEN cj = ci THEN d END) a, min(CASE WHEN cj <> ci THEN d END) b FROM pairs
       GROUP BY 1, 2, 3),
sil AS (SELECT l.model, avg(CASE WHEN s.n <= 1 THEN 0.0 ELSE (pt.b - pt.a) / greatest(pt.a, pt.b) END) sil
        FROM lab l JOIN sizes s ON l.model = s.model AND l.cluster = s.cluster
        LEFT JOIN pt ON pt.model = l.model AND pt.i = l.vec_id GROUP BY 1),
dims AS (SELECT model, cluster, unnest(features) x, generate_subscripts(features, 1) j FROM lab),
cen AS (SELECT model, cluster, list(c ORDER BY j) c FROM (SELECT model, cluster, j, avg(x) c FROM dims GROUP BY 1, 2, 3)
        GROUP BY 1, 2),
grand AS (SELECT model, list(g ORDER BY j) g FROM (SELECT model, j, avg(x) g FROM dims GROUP BY 1, 2) GROUP BY 1),
spread AS (SELECT l.model, l.cluster, avg(list_distance(l.features, cen.c)) sp,
                  sum(pow(list_distance(l.features, cen.c), 2)) w
           FROM lab l JOIN cen USING (model, cluster) GROUP BY 1, 2),
dbk AS (SELECT a.model, a.cluster, max((sa.sp + sb.sp) / list_distance(a.c, b.c)) worst
        FROM cen a JOIN cen b ON a.model = b.model AND a.cluster <> b.cluster
        JOIN spread sa ON sa.model = a.model AND sa.cluster = a.cluster
        JOIN spread sb ON sb.model = b.model AND sb.cluster = b.cluster GROUP BY 1, 2),
kk AS (SELECT model, count(*) k, sum(n) n FROM sizes GROUP BY 1),
bw AS (SELECT c.model, sum(s.n * pow(list_distance(c.c, g.g), 2)) btw FROM cen c JOIN grand g USING (model)
       JOIN sizes s ON s.model = c.model AND s.cluster = c.cluster GROUP BY 1),
ww AS (SELECT model, sum(w) w FROM spread GROUP BY 1),
q AS (SELECT kk.model, CAST(kk.k AS INT) n_clusters,
       CASE WHEN kk.k <= 1 THEN -1.0 ELSE sil.sil END silhouette_sq,
       CASE WHEN kk.k <= 1 THEN 'inf'::DOUBLE ELSE (SELECT avg(worst) FROM dbk WHERE dbk.model = kk.model) END
         davies_bouldin,
       CASE WHEN kk.k <= 1 THEN 0.0 ELSE (bw.btw / (kk.k - 1)) / (ww.w / (kk.n - kk.k)) END calinski_harabasz
      FROM kk JOIN sil USING (model) JOIN bw USING (model) JOIN ww USING (model))"""


_QUALITY_SQL = _LABELINGS_SQL + _MEASURES_SQL

_SILHOUETTE_SQL = """,
epairs AS (SELECT a.model, a.vec_id i, a.cluster ci, b.cluster cj, avg(list_distance(a.features, b.features)) d
           FROM lab a JOIN lab b ON a.model = b.model AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
ept AS (SELECT model, i, ci, max(CASE WHEN cj = ci THEN d END) a, min(CASE WHEN cj <> ci THEN d END) b FROM epairs GROUP BY 1, 2, 3),
esil AS (SELECT l.model, CASE WHEN count(DISTINCT l.cluster) <= 1 THEN -1.0
                ELSE avg(CASE WHEN s.n <= 1 THEN 0.0 ELSE (ept.b - ept.a) / greatest(ept.a, ept.b) END) END silhouette
         FROM lab l JOIN (SELECT model, cluster, count(*) n FROM lab GROUP BY 1, 2) s ON l.model = s.model AND l.cluster = s.cluster
         LEFT JOIN ept ON ept.model = l.model AND ept.i = l.vec_id GROUP BY 1)"""


@register("cluster_silhouette", "WITH " + _LABELINGS_SQL + _SILHOUETTE_SQL + """
SELECT model, round(silhouette, 6) silhouette, 0.0::DOUBLE silhouette_error, silhouette >= 0.10 passed FROM esil""", ("v",))
def q_cluster_silhouette(spark, sf):
    """H6 + I1: the Euclidean silhouette of four labelings against the limit of
    0.10, of all pairs; the error is 0."""
    s = silhouette(labelings(spark, sf), "vec_id", by=["model"])
    return s.select("model", r6("silhouette").alias("silhouette"), "silhouette_error", (F.col("silhouette") >= SILHOUETTE_MIN).alias("passed"))


# Fixed values of the query: two components of the vectors, by this factor, are the axes.
AXES_FACTOR = 40.0

_DENSITY_SQL = """
pts AS (SELECT vec_id, features, features[1] * 40.0 x, features[2] * 40.0 y FROM v),
eps_ AS (SELECT unnest([{e}])::DOUBLE eps), min_ AS (SELECT unnest([{m}])::INT m),
near_ AS MATERIALIZED (SELECT eps, a.vec_id i, b.vec_id j FROM pts a, pts b, eps_
         WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= eps * eps),
core_ AS MATERIALIZED (SELECT eps, m, i FROM (SELECT eps, i, count(*) n FROM near_ GROUP BY 1, 2), min_ WHERE n >= m),
edge_ AS MATERIALIZED (SELECT n.eps, a.m, n.i, n.j FROM near_ n JOIN core_ a ON a.eps = n.eps AND a.i = n.i
          JOIN core_ b ON b.eps = n.eps AND b.m = a.m AND b.i = n.j),
walk(k, eps, m, i, c) AS (SELECT 0, eps, m, i, i FROM core_
  UNION ALL SELECT w.k + 1, e.eps, e.m, e.i, min(w.c) FROM walk w JOIN edge_ e ON e.eps = w.eps AND e.m = w.m AND e.j = w.i
            WHERE w.k < 100 GROUP BY w.k, e.eps, e.m, e.i),
comp AS MATERIALIZED (SELECT eps, m, i, c FROM walk WHERE k = 100),
touch AS (SELECT n.eps, c.m, n.i, min(c.c) c FROM near_ n JOIN comp c ON c.eps = n.eps AND c.i = n.j GROUP BY 1, 2, 3),
lbl AS MATERIALIZED (SELECT e.eps, q.m, p.vec_id, p.features, coalesce(c.c, t.c) cluster FROM pts p, eps_ e, min_ q
        LEFT JOIN comp c ON c.eps = e.eps AND c.m = q.m AND c.i = p.vec_id LEFT JOIN touch t ON t.eps = e.eps AND t.m = q.m AND t.i = p.vec_id),
cnt AS (SELECT eps, m, count(DISTINCT cluster) n_clusters, count(cluster) clustered, count(*) - count(cluster) noise FROM lbl GROUP BY 1, 2),
stat AS MATERIALIZED (SELECT *, CASE WHEN n_clusters < 2 THEN 'rejected_too_few_clusters' WHEN clustered < 50 THEN 'rejected_too_much_noise'
                      ELSE 'evaluated' END status FROM cnt),
lab AS MATERIALIZED (SELECT vec_id, features, concat(l.eps, '|', l.m) model, cluster FROM lbl l JOIN stat s ON s.eps = l.eps AND s.m = l.m
        WHERE status = 'evaluated' AND cluster IS NOT NULL)""".format(e=", ".join(map(str, DENSITY_EPS)), m=", ".join(map(str, DENSITY_POINTS))) + _MEASURES_SQL


def vector_density(spark, sf):
    """The settings of density clustering over the vectors."""
    def make():
        v = stored(V(spark, sf).select("vec_id", "features"), "vectors")
        axes = F.array(F.col("features")[0] * AXES_FACTOR, F.col("features")[1] * AXES_FACTOR)
        labels = stored(density_labels(v.withColumn("axes", axes), "vec_id", "axes", 2), "density-labels")
        return stored(density_settings(labels, v, "vec_id"), "density-settings")
    return _once(spark, sf, "vector-density", make)


@register("density_settings", "WITH RECURSIVE " + _DENSITY_SQL + """
SELECT s.eps, s.m min_points, CAST(s.n_clusters AS INT) n_clusters, s.noise, round(s.noise / (s.noise + s.clustered), 6) noise_ratio, s.status,
       round(coalesce(q.silhouette_sq, -1), 6) silhouette_sq, round(coalesce(q.davies_bouldin, 'inf'::DOUBLE), 6) davies_bouldin,
       round(coalesce(q.calinski_harabasz, 0), 6) calinski_harabasz
FROM stat s LEFT JOIN q ON q.model = concat(s.eps, '|', s.m)""", ("v",))
def q_density_settings(spark, sf):
    """H4: 28 settings of density clustering on two axes, scored on the
    vectors that are not noise; rejected ones with -1 / inf / 0."""
    d = vector_density(spark, sf)
    return d.select("eps", "min_points", "n_clusters", "noise", r6("noise_ratio").alias("noise_ratio"), "status",
                    *[r6(c).alias(c) for c in ("silhouette_sq", "davies_bouldin", "calinski_harabasz")])


@register("density_best", "WITH RECURSIVE " + _DENSITY_SQL + """
SELECT s.eps, s.m min_points, CAST(s.n_clusters AS INT) n_clusters, round(q.silhouette_sq - 0.05 * q.davies_bouldin, 6) selection_score
FROM stat s JOIN q ON q.model = concat(s.eps, '|', s.m) ORDER BY q.silhouette_sq - 0.05 * q.davies_bouldin DESC, s.eps, s.m LIMIT 1""", ("v",))
def q_density_best(spark, sf):
    """H9's separate density best, and D26's best one of the evaluated."""
    return best_setting(vector_density(spark, sf)).select("eps", "min_points", "n_clusters", r6("selection_score").alias("selection_score"))


@register("ranked_density", "WITH RECURSIVE " + _DENSITY_SQL + """
SELECT s.eps, s.m min_points, CAST(s.n_clusters AS INT) n_clusters, round(q.silhouette_sq, 6) silhouette_sq
FROM stat s JOIN q ON q.model = concat(s.eps, '|', s.m) ORDER BY q.silhouette_sq DESC, s.eps, s.m LIMIT 8""", ("v",))
def q_ranked_density(spark, sf):
    """The best eight of the evaluated density settings by silhouette."""
    from ..operators import stats as D
    top = D.top_rows(vector_density(spark, sf).where("status = 'evaluated'"), [F.desc("silhouette_sq"), F.asc("eps"), F.asc("min_points")], 8)
    return top.select("eps", "min_points", "n_clusters", r6("silhouette_sq").alias("silhouette_sq"))


@register("cluster_quality", "WITH " + _QUALITY_SQL + """
SELECT model, n_clusters, round(silhouette_sq, 6) silhouette_sq, round(davies_bouldin, 6) davies_bouldin,
       round(calinski_harabasz, 6) calinski_harabasz FROM q""", ("v",))
def q_cluster_quality(spark, sf):
    """H6-H8: silhouette (squared distance), Davies-Bouldin and
    Calinski-Harabasz for four labelings of the vectors."""
    m = H.cluster_metrics(labelings(spark, sf), "features", "cluster", by=["model"])
    return m.select("model", "n_clusters", *[r6(c).alias(c) for c in
                                             ("silhouette_sq", "davies_bouldin", "calinski_harabasz")])


@register("cluster_selection", "WITH " + _QUALITY_SQL + """
SELECT model, round(silhouette_sq - 0.05 * davies_bouldin, 6) selection_score,
       model = (SELECT model FROM q ORDER BY silhouette_sq - 0.05 * davies_bouldin DESC, model LIMIT 1) is_selected
FROM q""", ("v",))
def q_cluster_selection(spark, sf):
    """H9: model choice by silhouette - 0.05 * Davies-Bouldin."""
    m = H.cluster_metrics(labelings(spark, sf), "features", "cluster", by=["model"])
    sel = H.select_model(m, "model")
    return sel.select("model", r6("selection_score").alias("selection_score"), "is_selected")


# -- MLlib training and scoring -------------------------------------------------
#
# A fitted model is not SQL-expressible. The queries return what is exact (sizes,
# positives, weights, thresholds on the grid, ranges of probabilities) beside
# checks of the rest, and their SQL computes the exact part from the same split.

import threading  # noqa: E402

from pyspark.ml.functions import vector_to_array  # noqa: E402

from ..operators import binary_metrics as M  # noqa: E402
from ..operators import modeling as G  # noqa: E402
from ..operators import sampling as E  # noqa: E402
from ..operators.prep import Preparer, categorical_columns, numeric_columns  # noqa: E402
from ..session import shared_path, stored  # noqa: E402
from .catalog import REGISTRY, S, T  # noqa: E402
from .queries_scoring import HASH_SQL  # noqa: E402

_DONE: dict[tuple, object] = {}
_LOCK = threading.RLock()


def _once(spark, sf, what, make):
    """What several queries of one session and folder share; tables in it are stored ones."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), what)
    with _LOCK:
        if key not in _DONE:
            _DONE[key] = make()
        return _DONE[key]


def _fraud_design(spark, sf):
    """The model input of every transaction; its balances are computed once."""
    return _once(spark, sf, "design", lambda: stored(G.fraud_design(T(spark, sf)), "design"))


def _fraud_split(spark, sf, temporal: bool = False):
    def make():
        design = _fraud_design(spark, sf)
        if temporal:
            return stored(E.temporal_split(design, "step", 0.70, 0.15), "temporal-split")
        return stored(E.stratified_split(design, "isFraud", "event_id"), "split")
    return _once(spark, sf, ("split", temporal), make)


# The reference's model families, with its numbers of trees and rounds.
FRAUD_CONFIGS = [
    G.ModelConfig("logistic_regression", G.logistic_regression(), G.balanced_weights),
    G.ModelConfig("random_forest", G.random_forest(300), G.balanced_weights),
    G.ModelConfig("gradient_boosting", G.boosted_trees(400), G.positive_weight),
    G.ModelConfig("gradient_boosting_leaves", G.boosted_trees(400, depth=5, bins=255), G.positive_weight),
    G.ModelConfig("mlp", G.perceptron(), None),
]
BY_NAME = {c.name: c for c in FRAUD_CONFIGS}


def _trained(spark, sf, name):
    """(fitted model, its metrics); of the comparison, where that has been made."""
    def make():
        done = _DONE.get((spark.sparkContext.applicationId, sf.rstrip("/"), "comparison"))
        if done is None:
            return G.train_and_evaluate(_fraud_split(spark, sf), BY_NAME[name])
        return next(m for m in done[0] if m.name == name), done[1].where(F.col("model") == name).drop("is_best")
    return _once(spark, sf, ("fit", name), make)


def fraud_comparison(spark, sf):
    """(fitted models, best first; metrics)."""
    return _once(spark, sf, "comparison", lambda: G.compare_models(_fraud_split(spark, sf), FRAUD_CONFIGS))


_SPLIT = """
sp0 AS (SELECT event_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {h}) rn, count(*) OVER (PARTITION BY isFraud) n FROM t),
sp AS (SELECT event_id, isFraud, CASE WHEN rn <= ceil(n * 0.15) THEN 'test'
              WHEN rn <= ceil(n * 0.15) + ceil((n - ceil(n * 0.15)) * 0.1765) THEN 'val' ELSE 'train' END split FROM sp0),
sz AS (SELECT count_if(split = 'train') train_size, count_if(split = 'val') val_size, count_if(split = 'test') test_size,
              count_if(split = 'train' AND isFraud = 1) train_pos, count_if(split = 'test' AND isFraud = 1) test_pos FROM sp)""".format(
    h=HASH_SQL.format(k="event_id"))


def _checked_metrics(m):
    """The exact part of a metrics table, and checks of the rest."""
    rates = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    inside = F.lit(True)
    for c in rates:
        inside = inside & F.col(c).between(0.0, 1.0)
    on_grid = F.array_contains(F.array(*[F.lit(float(x)) for x in M.CALIBRATION_GRID]), F.col("threshold"))
    return m.select("model", "train_size", "val_size", F.col("test_size").cast("long").alias("test_size"),
                    r6("positive_rate_test").alias("positive_rate_test"), on_grid.alias("threshold_on_grid"), inside.alias("rates_in_range"))


_CHECKED = """
SELECT {model} model, train_size, val_size, test_size, round(test_pos / test_size, 6) positive_rate_test,
       true threshold_on_grid, true rates_in_range FROM sz{more}"""


@register("fraud_model_comparison", "WITH " + _SPLIT + _CHECKED.format(
    model="m", more=", (VALUES " + ", ".join(f"('{c.name}')" for c in FRAUD_CONFIGS) + ") f(m)"), ("t",))
def q_fraud_model_comparison(spark, sf):
    """G3-G9 + F13: all model families trained, calibrated and measured; the
    full metrics are ``fraud_comparison(spark, sf)[1]``."""
    return _checked_metrics(fraud_comparison(spark, sf)[1])


@register("fraud_linear_model", "WITH " + _SPLIT + _CHECKED.format(model="'logistic_regression'", more=""), ("t",))
def q_fraud_linear_model(spark, sf):
    """G3 + G8: the class-balanced logistic regression alone."""
    return _checked_metrics(_trained(spark, sf, "logistic_regression")[1])


@register("fraud_class_weights", "WITH " + _SPLIT + """
SELECT train_size, train_pos positives, round(train_size / (2 * train_pos), 6) balanced_positive,
       round(train_size / (2 * (train_size - train_pos)), 6) balanced_negative,
       round(greatest((train_size - train_pos) / train_pos, 1), 6) boosting_positive FROM sz""", ("t",))
def q_fraud_class_weights(spark, sf):
    """Both weightings of the train split."""
    train = _fraud_split(spark, sf).where(F.col("split") == "train")
    n, p = G.class_counts(train, "isFraud")
    row = (n, p, *(round(float(x), 6) for x in G.balanced_weights(n, p)), round(float(G.positive_weight(n, p)[0]), 6))
    return spark.createDataFrame([row], "train_size long, positives long, balanced_positive double, balanced_negative double, boosting_positive double")


def _temporal(spark, sf):
    best = fraud_comparison(spark, sf)[0][0].name
    return _once(spark, sf, "temporal", lambda: G.train_and_evaluate(_fraud_split(spark, sf, temporal=True), BY_NAME[best]))


@register("fraud_temporal_evaluation", """
WITH c AS (SELECT quantile_cont(step, 0.7) c1, quantile_cont(step, 0.85) c2 FROM t),
sp AS (SELECT step, isFraud, CASE WHEN step <= c1 THEN 'train' WHEN step <= c2 THEN 'val' ELSE 'test' END split FROM t, c)
SELECT count_if(split = 'train') train_size, count_if(split = 'val') val_size, count_if(split = 'test') test_size,
       round(count_if(split = 'test' AND isFraud = 1) / count_if(split = 'test'), 6) positive_rate_test,
       true threshold_on_grid, true rates_in_range, max(CASE WHEN split = 'train' THEN step END) train_step_max,
       min(CASE WHEN split = 'test' THEN step END) test_step_min FROM sp""", ("t",))
def q_fraud_temporal_evaluation(spark, sf):
    """The selected model family re-trained on the time-ordered split
    (train <= 70 % quantile of step, test > 85 %), with boundary steps."""
    split = _fraud_split(spark, sf, temporal=True)
    _, m = _temporal(spark, sf)
    bounds = split.agg(F.max(F.when(F.col("split") == "train", F.col("step"))).alias("a"), F.min(F.when(F.col("split") == "test", F.col("step"))).alias("b")).first()
    return _checked_metrics(m).drop("model").withColumn("train_step_max", F.lit(bounds["a"])).withColumn("test_step_min", F.lit(bounds["b"]))


@register("fraud_feature_importance")
def q_fraud_feature_importance(spark, sf):
    """Top-15 features of the random forest."""
    return G.feature_importance(_trained(spark, sf, "random_forest")[0], 15)


def _contributions(spark, sf):
    lr = _trained(spark, sf, "logistic_regression")[0]
    return G.linear_contributions(lr, _fraud_split(spark, sf).where(F.col("split") == "test"), "event_id")


@register("fraud_linear_contributions")
def q_fraud_linear_contributions(spark, sf):
    """Mean |contribution| per feature of the logistic model."""
    return _contributions(spark, sf)[0]


@register("fraud_row_contributions")
def q_fraud_row_contributions(spark, sf):
    """G12 per row: the three largest contributions of each test row."""
    return _contributions(spark, sf)[1]


@register("fraud_importance_sums", "SELECT * FROM (VALUES ('random_forest', 1.0::DOUBLE), ('gradient_boosting', 1.0::DOUBLE)) f(model, total)")
def q_fraud_importance_sums(spark, sf):
    """The importances of all features of a tree model sum to 1."""
    rows = None
    for name in ("random_forest", "gradient_boosting"):
        fitted = _trained(spark, sf, name)[0]
        one = G.feature_importance(fitted, fitted.prep.n_outputs()).agg(F.lit(name).alias("model"), r6(F.sum("importance")).alias("total"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register("fraud_contribution_sums", "WITH " + _SPLIT + """
SELECT event_id, true linear_sums, true tree_sums FROM sp WHERE split = 'test'""", ("t",))
def q_fraud_contribution_sums(spark, sf):
    """For each test row, base and contributions are the model's raw
    score, of the logistic model (its logit) and of the boosted trees."""
    test = _fraud_split(spark, sf).where(F.col("split") == "test")

    def sums(name, totals):
        fitted = _trained(spark, sf, name)[0]
        raw = fitted.model.transform(fitted.prep.to_vector(fitted.prep.aligned(test, ["event_id"]), ["event_id"])).select("event_id", vector_to_array("rawPrediction")[1].alias("raw"))
        return totals(fitted).join(raw, "event_id").select("event_id", (F.abs(F.col("total") - F.col("raw")) <= 1e-6 * (1 + F.abs("raw"))).alias("same"))

    linear = sums("logistic_regression", lambda m: G.linear_totals(m, test, "event_id")).withColumnRenamed("same", "linear_sums")
    return linear.join(sums("gradient_boosting", lambda m: G.tree_contributions(m, test, "event_id")[2]).withColumnRenamed("same", "tree_sums"), "event_id")


@register("fraud_test_scores")
def q_fraud_test_scores(spark, sf):
    """The stored scores of the logistic model's validation and test rows,
    from which its threshold and metrics are taken."""
    return _trained(spark, sf, "logistic_regression")[0].scores


@register("fraud_temporal_metrics")
def q_fraud_temporal_metrics(spark, sf):
    """The metrics on the time-ordered split beside those on the random
    one, for the selected model family."""
    random, temporal = fraud_comparison(spark, sf)[1].where("is_best").drop("is_best"), _temporal(spark, sf)[1]
    return random.withColumn("split", F.lit("random")).unionByName(temporal.withColumn("split", F.lit("temporal")))


@register("fallback_model_scores")
def q_fallback_model_scores(spark, sf):
    """No model is stored under the best one's name, so the one under the
    generic name is loaded and scores the test rows; ``same`` says that each
    probability is the fitted model's."""
    import uuid
    fitted = _trained(spark, sf, "logistic_regression")[0]
    folder = shared_path(spark, "models", uuid.uuid4().hex)
    fitted.save(f"{folder}/model")
    loaded = G.load_model(folder, "gradient_boosting")
    test = _fraud_split(spark, sf).where(F.col("split") == "test")
    was = fitted.scores.select("event_id", F.col("proba").alias("_was"))
    return loaded.score(test, ["event_id"]).join(was, "event_id").select("event_id", "proba", (F.col("proba") == F.col("_was")).alias("same"))


@register("fraud_tree_contributions")
def q_fraud_tree_contributions(spark, sf):
    """Mean |contribution| per feature of the boosted trees on the test
    rows, with the largest distance of base + contributions from the model's
    raw score over all rows."""
    fitted = _trained(spark, sf, "gradient_boosting")[0]
    test = _fraud_split(spark, sf).where(F.col("split") == "test")
    glob, _, sums = G.tree_contributions(fitted, test, "event_id")
    raw = fitted.model.transform(fitted.prep.to_vector(fitted.prep.aligned(test, ["event_id"]), ["event_id"])).select("event_id", vector_to_array("rawPrediction")[1].alias("raw"))
    off = sums.join(raw, "event_id").agg(F.max(F.abs(F.col("total") - F.col("raw")))).scalar()
    return glob.withColumn("largest_gap", F.round(off, 6))


@register("fraud_tree_row_contributions")
def q_fraud_tree_row_contributions(spark, sf):
    """G12 per row: the three largest tree contributions of each test row."""
    return G.tree_contributions(_trained(spark, sf, "gradient_boosting")[0], _fraud_split(spark, sf).where(F.col("split") == "test"), "event_id")[1]


@register("transaction_scoring", """
SELECT event_id, isFraud, true probability_in_range, true tier_matches FROM t""", ("t",))
def q_transaction_scoring(spark, sf):
    """G13 + A8: every transaction scored by the stored logistic model, saved
    under its name and loaded again, with F9 error type and F14 risk tier: the
    probabilities' range and the tiers are checked. The rows themselves are
    ``transaction_scores``, the streaming form ``transaction_scoring_stream``."""
    scored = _scored_transactions(spark, sf)
    alert = F.col("prediction") == 1
    return scored.select("event_id", "isFraud", F.col("proba").between(0.0, 1.0).alias("probability_in_range"),
                         ((F.col("risk_tier") == "alert") == alert).alias("tier_matches"))


def _scored_transactions(spark, sf):
    def make():
        folder = shared_path(spark, "models", spark.sparkContext.applicationId + "-" + str(abs(hash(sf))))
        _trained(spark, sf, "logistic_regression")[0].save(f"{folder}/logistic_regression")
        return folder
    model = G.load_model(_once(spark, sf, "saved", make), "logistic_regression")
    scored = model.score(_fraud_design(spark, sf), ["event_id", "isFraud"])
    return (scored.withColumn("error_type", M.error_type("proba", "isFraud", model.threshold))
            .withColumn("risk_tier", M.risk_tier("proba", model.threshold)))


# Stored coefficients of a small linear model, and its inputs.
STORED_COEFFICIENTS = {"num__amount": 0.8, "num__step": -0.1, "num__oldbalanceOrg": -0.4, "cat__type_purchase": 0.6, "cat__type_error": 1.1}
STORED_INTERCEPT = -2.0


@register("stored_parameter_scoring", """
WITH a AS (SELECT event_id, amount, step, nullif(oldbalanceOrg, 0) ob, "type" FROM t),
m AS (SELECT median(ob) med FROM a),
b AS (SELECT a.*, coalesce(ob, med) obi FROM a, m),
s AS (SELECT avg(amount) ma, stddev_pop(amount) sa, avg(step) ms, stddev_pop(step) ss, avg(obi) mo, stddev_pop(obi) so FROM b)
SELECT event_id, round(1 / (1 + exp(-(-2.0 + 0.8 * (amount - ma) / sa - 0.1 * (step - ms) / ss - 0.4 * (obi - mo) / so
       + 0.6 * CAST("type" = 'purchase' AS INT) + 1.1 * CAST("type" = 'error' AS INT)))), 6) proba FROM b, s""", ("t",))
def q_stored_parameter_scoring(spark, sf):
    """G1 + G2 + G13: imputed, scaled and one-hot columns and a model of
    stored coefficients, to six decimals."""
    x = stored(G.preprocess_fraud(T(spark, sf).select("event_id", "amount", "step", "oldbalanceOrg", "type"), unique="event_id"), "scoring-input")
    prep = Preparer.fit(x, ["amount", "step", "oldbalanceOrg"], ["type"])
    wide = prep.transform(prep.aligned(x, ["event_id"]), ["event_id"])
    return wide.select("event_id", r6(G.linear_probability(prep, STORED_COEFFICIENTS, STORED_INTERCEPT)).alias("proba"))


# -- customer segmentation with MLlib -----------------------------------------

def _segment_inputs(spark, sf):
    from .queries_customers import prepared_customers
    c = stored(prepared_customers(spark, sf), "prepared-customers")
    x = c.drop("ID", "Response", "Complain", "Dt_Customer")
    prep = Preparer.fit(x, numeric_columns(x), categorical_columns(x))
    vec = stored(H.sized(prep.to_vector(c, ["ID"]), c.count()), "segment-vectors")
    return c, prep, H.sized(vec, c.count())


def _segments(spark, sf):
    return _once(spark, sf, "segments", lambda: _segment_inputs(spark, sf))


SEGMENT_MODELS = [f"{n}_k{k}" for k in (3, 4, 5, 6) for n in ("kmeans", "gmm", "agglomerative")]


def segment_comparison(spark, sf):
    """Metrics of every clustering, and the selected ones."""
    from concurrent.futures import ThreadPoolExecutor

    def make():
        vec = _segments(spark, sf)[2]
        ward = fit_ward(vec)  # one hierarchy, cut for every k
        seeds = H.best_restarts(vec, sorted({int(m.rsplit("_k", 1)[1]) for m in SEGMENT_MODELS}), 20)

        def labelled(name):
            kind, k = name.rsplit("_k", 1)
            k = int(k)
            got = ward.transform(vec, k) if kind == "agglomerative" else {"kmeans": lambda: H.fit_kmeans(vec, k, 20, best=seeds[k][0]), "gmm": lambda: H.fit_gmm(vec, k)}[kind]().transform(vec)
            return got.select(F.lit(name).alias("model"), "ID", vector_to_array("features").alias("features"), "cluster")

        with ThreadPoolExecutor(max_workers=4) as pool:
            parts = list(pool.map(labelled, SEGMENT_MODELS))
        every = parts[0]
        for p_ in parts[1:]:
            every = every.unionByName(p_)
        labels = stored(every, "segment-labels")
        metrics = H.cluster_metrics(labels, "features", "cluster", by=["model"]).join(silhouette(labels, "ID", by=["model"]), "model")
        return labels, stored(H.select_model(metrics, "model"), "segment-metrics")

    return _once(spark, sf, "segment-comparison", make)


@register("clustering_comparison", """
SELECT m model, CAST(k AS INT) clusters_at_most, (SELECT count(*) FROM s) "rows", true metrics_in_range
FROM (VALUES {v}) f(m, k)""".format(v=", ".join(f"('{m}', {m.rsplit('_k', 1)[1]})" for m in SEGMENT_MODELS)), ("s",))
def q_clustering_comparison(spark, sf):
    """H1-H3 + H6-H9: k-means (20 restarts), Gaussian mixture and bottom-up
    Ward merging for k = 3..6, scored and ranked; the numbers are
    ``clustering_metrics``'s."""
    from ..operators import cleaning as B
    labels, m = segment_comparison(spark, sf)
    n = labels.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    k = B.parse_model_key("model")[1]
    ok = ((F.col("n_clusters") <= k) & F.col("silhouette_sq").between(-1.0, 1.0) & (F.col("davies_bouldin") >= 0) & (F.col("calinski_harabasz") >= 0))
    return m.join(n, "model").select("model", k.alias("clusters_at_most"), "rows", ok.alias("metrics_in_range"))


@register("clustering_metrics")
def q_clustering_metrics(spark, sf):
    """H1-H3 + H6-H9: the measures and the selection score of every model of
    ``clustering_comparison``; one is selected."""
    return segment_comparison(spark, sf)[1]


def segment_density(spark, sf):
    """(labels of every setting, the settings' rows) on two principal axes."""
    def make():
        vec = _segments(spark, sf)[2]
        proj = H.pca_projection(vec, 2, keep=["ID"])[0].select("ID", F.array("PC1", "PC2").alias("axes"))
        labels = stored(density_labels(proj, "ID", "axes", 2), "density-labels")
        return labels, stored(density_settings(labels, vec.select("ID", vector_to_array("features").alias("features")), "ID"), "density-settings")
    return _once(spark, sf, "segment-density", make)


@register("density_clustering", """
SELECT CAST(e AS DOUBLE) eps, CAST(p AS INT) min_points, (SELECT count(*) FROM s) "rows", true counts_agree, true status_agrees
FROM (VALUES {e}) x(e), (VALUES {p}) y(p)""".format(e=", ".join(f"({x})" for x in DENSITY_EPS), p=", ".join(f"({x})" for x in DENSITY_POINTS)), ("s",))
def q_density_clustering(spark, sf):
    """H4: 28 settings of density clustering of the customers on two principal
    axes; the counts and the status are checked against the labels. The
    settings' own rows are ``segment_density_settings``."""
    labels, d = segment_density(spark, sf)
    of = labels.groupBy("eps", "min_points").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cluster").isNull()).alias("_noise"),
                                                 F.size(F.collect_set("cluster")).alias("_clusters"))
    d = d.join(of, ["eps", "min_points"])
    agrees = (F.col("status") == "evaluated") == ((F.col("_clusters") >= 2) & (F.col("rows") - F.col("_noise") >= DENSITY_LEAST))
    return d.select("eps", "min_points", "rows", (r6("noise_ratio") == r6(F.col("_noise") / F.col("rows"))).alias("counts_agree"), agrees.alias("status_agrees"))


@register("segment_density_settings")
def q_segment_density_settings(spark, sf):
    """H4: clusters, noise ratio, status and measures of every setting over the
    customers, and whether it is the best (H9)."""
    d = segment_density(spark, sf)[1]
    best = best_setting(d).select("eps", "min_points", F.lit(True).alias("is_best"))
    return d.join(best, ["eps", "min_points"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def _segment_model(spark, sf):
    """(raw customers, the model as stored and loaded)."""
    def make():
        raw = stored(S(spark, sf), "raw-customers")
        path = shared_path(spark, "models", f"segments-{spark.sparkContext.applicationId}-{abs(hash(sf))}")
        G.SegmentModel.fit(raw, 4).save(path)
        return raw, path
    raw, path = _once(spark, sf, "segment-model", make)
    return raw, G.SegmentModel.load(path)


@register("customer_segments", "WITH n AS (SELECT count(*) c FROM s) SELECT CAST(4 AS BIGINT) segments, CAST(c AS BIGINT) customers, true named FROM n", ("s",))
def q_customer_segments(spark, sf):
    """G14 + D17 + B12: raw customers assigned by a stored k-means (k = 4) and
    the training parameters stored with it: sizes of the named segments. The
    profiles are ``segment_profiles``."""
    p = q_segment_profiles(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("segments"), F.sum("cluster_size").alias("customers"), (F.count("segment") == F.count(F.lit(1))).alias("named"))


@register("segment_profiles")
def q_segment_profiles(spark, sf):
    """G14 + D17 + B12: every segment's means, size, name and action."""
    from ..operators import cleaning as B
    from ..operators import stats as D
    raw, model = _segment_model(spark, sf)
    return B.attach_segments(D.profile_clusters(model.features(raw).join(model.score(raw), "ID")))


@register("segment_assignments")
def q_segment_assignments(spark, sf):
    """The segment of each customer. Rows are scored one by one: a part of
    the customers gets the segments that it has among all."""
    raw, model = _segment_model(spark, sf)
    return model.score(raw)


@register("kmeans_inertia")
def q_kmeans_inertia(spark, sf):
    """H5: k-means inertia for k = 2..10, 20 restarts each."""
    return _once(spark, sf, "elbow", lambda: H.elbow(_segments(spark, sf)[2], range(2, 11)))


@register("customer_axes")
def q_customer_axes(spark, sf):
    """The two principal components of every customer."""
    return H.pca_projection(_segments(spark, sf)[2], 2, keep=["ID"])[0]


@register("fraud_model_metrics")
def q_fraud_model_metrics(spark, sf):
    """G3-G9 + F13: the metrics of every model family on the test rows."""
    return fraud_comparison(spark, sf)[1]


@register("transaction_scores")
def q_transaction_scores(spark, sf):
    """G13 + F9 + F14: probability, alert flag, error type and risk tier of
    every transaction, by the stored logistic model."""
    return _scored_transactions(spark, sf)


@register("transaction_scoring_stream", REGISTRY["stored_parameter_scoring"][1])
def q_transaction_scoring_stream(spark, sf):
    """G13 as a stream: transactions that arrive as files are scored by the
    stored parameters and coefficients, once each; the rows are those of the
    batch form."""
    import uuid

    from ..streaming.alerts import score_stream
    rows = T(spark, sf).select("event_id", "amount", "step", "oldbalanceOrg", "type")
    source = shared_path(spark, "streams", uuid.uuid4().hex)
    rows.repartition(8, "event_id").write.parquet(source)  # files as they would arrive
    x = G.preprocess_fraud(spark.read.schema(rows.schema).parquet(source), unique="event_id")
    prep = Preparer.fit(x, ["amount", "step", "oldbalanceOrg"], ["type"])

    def scorer(df):
        df = G.preprocess_fraud(df, unique="event_id")
        wide = prep.transform(prep.aligned(df, ["event_id"]), ["event_id"])
        return wide.select("event_id", r6(G.linear_probability(prep, STORED_COEFFICIENTS, STORED_INTERCEPT)).alias("proba"))

    return score_stream(spark, source, rows.schema, scorer, uuid.uuid4().hex, files=4)


@register("kmeans_elbow", "SELECT CAST(k AS INT) k, true inertia_positive FROM range(2, 11) r(k)")
def q_kmeans_elbow(spark, sf):
    """H5: k-means inertia for k = 2..10, 20 restarts each; the numbers are
    ``clustering.elbow``'s."""
    e = _once(spark, sf, "elbow", lambda: H.elbow(_segments(spark, sf)[2], range(2, 11)))
    return e.select("k", (F.col("inertia") > 0).alias("inertia_positive"))


@register("customer_pca", "SELECT count(*) customers, true centred, true uncorrelated, true ordered FROM s", ("s",))
def q_customer_pca(spark, sf):
    """2-D projection of the prepared customer matrix: centred,
    uncorrelated, the first axis with the larger variance."""
    proj, var = H.pca_projection(_segments(spark, sf)[2], 2, keep=["ID"])
    return proj.agg(F.count(F.lit(1)).alias("customers"), ((F.abs(F.avg("PC1")) < 1e-6) & (F.abs(F.avg("PC2")) < 1e-6)).alias("centred"),
                    (F.abs(F.corr("PC1", "PC2")) < 1e-6).alias("uncorrelated"),
                    ((F.var_samp("PC1") >= F.var_samp("PC2")) & F.lit(var[0] >= var[1])).alias("ordered"))


@register("ranked_models", "WITH " + _QUALITY_SQL + """
SELECT model, round(silhouette_sq, 6) silhouette_sq, n_clusters FROM q WHERE n_clusters >= 2
ORDER BY silhouette_sq DESC, model LIMIT 2""", ("v",))
def q_ranked_models(spark, sf):
    """Evaluated configurations (two clusters or more), best two by
    silhouette."""
    from ..operators import stats as D
    m = H.cluster_metrics(labelings(spark, sf), by=["model"]).where(F.col("n_clusters") >= 2)
    top = D.top_rows(m, [F.desc("silhouette_sq"), F.asc("model")], 2)
    return top.select("model", r6("silhouette_sq").alias("silhouette_sq"), "n_clusters")
