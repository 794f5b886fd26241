"""Gradient-boosted trees of many rows (inventory G5, G6).

MLlib's algorithm (variance splits of the log-loss residuals, weighted rows,
Bernoulli subsets of rows a tree and of features a node) in another layout.
Features are replaced by their bin once. Rows that agree in every bin, label
and weight have the same margin for good, so they become one row with a count,
from which a tree draws a binomial number. A task keeps its rows as a few
arrays: features of few bins share one array of joint bins, so a level costs one
weighted count for each such array and not for each feature. Of two
children only the lighter one is counted; the other is the parent without it.

Thresholds are values of summaries of all rows, not of a sample. A level is one
job, and histograms of at most ``2 ** depth`` nodes reach the driver, where
the splits are chosen. Up to ``ONE_TASK`` different rows are a bounded table, whose
levels take less time than jobs: one task then makes all rounds, in the
same way. The result is an MLlib model."""

from __future__ import annotations

import json
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, stored

#: Joint bins of one array at most; the counts of a level's nodes then stay in a core's cache.
CELLS = 1_024
#: Rows of a task at least (small sets don't pay for many tasks a level) and at most.
LEAST_ROWS, MOST_ROWS = 20_000, 1_000_000
#: Up to so many different rows one task makes all rounds (some 70 bytes a row).
ONE_TASK = 1_000_000
#: Vectors of more numbers are left to MLlib.
MOST_FEATURES = 1_000
#: The state of the rows is checkpointed after so many trees, as in MLlib.
CHECKPOINT_TREES = 10
#: Partial counts of more tasks than this are added up among the executors.
MOST_PARTS = 32


@dataclass
class Layout:
    """Thresholds of each feature, and the arrays of joint bins: for each its
    features with the factor of their bin."""

    thresholds: list[np.ndarray]
    packs: list[list[tuple[int, int]]]

    def place(self) -> dict[int, tuple[int, int]]:
        return {f: (g, factor) for g, pack in enumerate(self.packs) for f, factor in pack}

    def bins(self, f: int) -> int:
        return len(self.thresholds[f]) + 1

    def size(self) -> int:
        return max((factor * self.bins(f) for pack in self.packs for f, factor in pack), default=1)


def layout(thresholds: list[np.ndarray]) -> Layout:
    packs: list[list[tuple[int, int]]] = []
    sizes: list[int] = []
    for f in sorted((f for f, t in enumerate(thresholds) if len(t)), key=lambda f: (-len(thresholds[f]), f)):
        n = len(thresholds[f]) + 1
        g = next((i for i, s in enumerate(sizes) if s * n <= CELLS), len(packs))
        if g == len(packs):
            packs.append([])
            sizes.append(1)
        packs[g].append((f, sizes[g]))
        sizes[g] *= n
    return Layout(thresholds, packs)


def find_thresholds(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` thresholds a feature (left is ``<=``): between all
    values of one that has few, else quantiles of all its values. ``rows``
    has the vectors as ``_x``; NaN is above every threshold."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * d
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for f in range(d):
                if seen[f] is not None:
                    v = x[:, f]
                    v = np.unique(np.concatenate([seen[f], v[~np.isnan(v)] + 0.0]))
                    seen[f] = v if len(v) <= bins else None
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(seen, pa.list_(pa.float64()))], ["f", "v"])

    found: list[np.ndarray | None] = [np.zeros(0)] * d
    for r in rows.select("_x").mapInArrow(few, "f int, v array<double>").groupBy("f").agg(
            F.when(F.count("v") == F.count(F.lit(1)), F.flatten(F.collect_list("v"))).alias("v")).collect():
        found[r["f"]] = None if r["v"] is None else np.unique(r["v"])
        if found[r["f"]] is not None and len(found[r["f"]]) > bins:
            found[r["f"]] = None
    many = [f for f in range(d) if found[f] is None]
    marks: dict[int, np.ndarray] = {}
    if many:
        at = [i / bins for i in range(1, bins)]
        value = {f: F.get("_x", F.lit(f)) for f in many}
        got = rows.agg(*[F.percentile_approx(F.when(~F.isnan(value[f]), value[f]), at, 100 * bins).alias(f"_{f}") for f in many],
                       *[F.max(F.when(~F.isnan(value[f]), value[f])).alias(f"_top{f}") for f in many]).first()
        marks = {f: (lambda v, top: v[v < top])(np.unique(got[f"_{f}"]), got[f"_top{f}"]) for f in many}
    return [marks[f] if v is None else _between(v) for f, v in enumerate(found)]


def _between(v: np.ndarray) -> np.ndarray:
    """The middle of each two neighbours; the lower one where there is none."""
    with np.errstate(all="ignore"):
        mid = v[:-1] + (v[1:] - v[:-1]) / 2
    return np.where((mid >= v[:-1]) & (mid < v[1:]), mid, v[:-1])


def _binned(plan: Layout, d: int):
    """Rows as bytes of bins with label, weight and how many of a batch agree."""
    used = [f for f in range(d) if len(plan.thresholds[f])]
    kind = np.uint8 if max((plan.bins(f) for f in used), default=1) <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            code = np.empty((len(x), len(used)), kind)
            for i, f in enumerate(used):
                code[:, i] = np.searchsorted(plan.thresholds[f], x[:, f], "left")
            own = np.ascontiguousarray(np.concatenate([code.view(np.uint8), np.array(batch.column(1), float).reshape(-1, 1).view(np.uint8),
                                                       np.array(batch.column(2), float).reshape(-1, 1).view(np.uint8)], axis=1))
            keys, n = np.unique(own.view(np.dtype((np.void, own.shape[1]))).ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n)], ["key", "n"])

    return run, len(used), kind


def _packed(plan: Layout, n_used: int, kind):
    """A task's rows as pickled arrays: (number, joint bins, label as -1 or 1, weight, count)."""
    used = [f for f in range(len(plan.thresholds)) if len(plan.thresholds[f])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n_used * np.dtype(kind).itemsize
        keys, counts = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            counts.append(np.array(batch.column(1), float))
        if not keys:
            return
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
        code = np.ascontiguousarray(raw[:, :size]).view(kind).reshape(len(keys), n_used)
        label, weight = (np.ascontiguousarray(raw[:, size + 8 * i:size + 8 * i + 8]).view(float).ravel() for i in (0, 1))
        joint = np.zeros((len(plan.packs), len(keys)), np.uint16)
        column = {f: i for i, f in enumerate(used)}
        for g, pack in enumerate(plan.packs):
            for f, factor in pack:
                joint[g] += code[:, column[f]].astype(np.uint16) * np.uint16(factor)
        # the number names the rows' draws, whatever task reads them
        blob = pickle.dumps((zlib.crc32(raw), joint, np.where(label > 0, 1.0, -1.0), weight, np.concatenate(counts)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    return run


@dataclass
class Tree:
    """Nodes in heap order: 2 i + 1 and 2 i + 2 are the children of i. ``feature``
    is -1 in a leaf, and ``cut`` the last bin that goes left."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    step: float = 1.0
    count: np.ndarray | None = None
    square: np.ndarray | None = None

    @classmethod
    def empty(cls, depth: int, step: float) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.full(n, -1.0), np.zeros(n), np.zeros(n), step)

    def value(self) -> np.ndarray:
        return np.where(self.weight > 0, self.total / np.where(self.weight > 0, self.weight, 1.0), 0.0)


def nodes_of(plan: Layout, tree: Tree, joint: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row reaches after ``levels`` steps, or its leaf before."""
    place, cells, n = plan.place(), plan.size(), joint.shape[1]
    node = np.zeros(n, np.int64)
    flat, row = joint.ravel(), np.arange(n)
    at = np.arange(cells)
    for level in range(levels):
        first, last = 2 ** level - 1, 2 ** (level + 1) - 1
        inner = [i for i in range(first, last) if tree.feature[i] >= 0]
        if not inner:
            break
        pack = np.zeros(len(tree.feature), np.int64)
        goes = np.zeros((last - first, cells), np.int64)
        for i in inner:
            pack[i], factor = place[tree.feature[i]]
            goes[i - first] = 2 * i + 1 + (at // factor % plan.bins(tree.feature[i]) > tree.cut[i])
        if len(inner) == last - first:  # every row goes on
            node = goes.ravel()[(node - first) * cells + flat[pack[node] * n + row]]
        else:
            on = np.flatnonzero((tree.feature >= 0)[node] & (node >= first))
            of = node[on]
            node[on] = goes.ravel()[(of - first) * cells + flat[pack[of] * n + on]]
    return node


def _drawn(count: np.ndarray, rate: float, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each row's copies a tree gets."""
    if rate >= 1:
        return count
    rng = np.random.default_rng(seed)
    out = (rng.random(len(count)) < rate).astype(float)
    more = np.flatnonzero(count > 1)
    out[more] = rng.binomial(count[more].astype(np.int64), rate)
    return out


def _begun(rate: float, seed: int):
    def run(static):
        number, _, y, weight, count = static
        return np.zeros(len(y)), y, _drawn(count, rate, (seed, 0, number)) * weight, None
    return run


def _next(plan: Layout, tree: Tree, depth: int, rate: float, seed: int, round_: int):
    """The state after a tree: margins, residuals, the next tree's weights, and
    the counts and sums of squares of this tree's leaves."""
    value = tree.value()

    def run(both):
        (number, joint, y, weight, count), (margin, residual, drawn, _) = both
        node = nodes_of(plan, tree, joint, depth)
        leaves = np.stack([np.bincount(node, drawn / weight, len(value)), np.bincount(node, drawn * residual ** 2, len(value))])
        margin = margin + tree.step * value[node]
        with np.errstate(over="ignore"):
            residual = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
        return margin, residual, _drawn(count, rate, (seed, round_, number)) * weight, leaves
    return run


def _histograms(plan: Layout, tree: Tree, level: int, slots: dict[int, int]):
    """For the nodes of ``slots`` the weights and weighted residuals by joint bin
    of every array, and in front of them the state's sums of the last leaves."""
    cells, n_slots = plan.size(), max(1, len(slots))

    def one(both):
        (_, joint, _, _, _), (_, residual, drawn, leaves) = both
        pull = drawn * residual
        if level:
            slot = np.full(len(tree.feature), -1)
            slot[list(slots)] = list(slots.values())
            mine = slot[nodes_of(plan, tree, joint, level)]
            rows = np.flatnonzero((mine >= 0) & (drawn > 0))
            joint, pull, drawn, base = joint[:, rows], pull[rows], drawn[rows], mine[rows] * cells
        else:
            base = 0
        out = np.empty((2, len(joint), n_slots * cells))
        for g in range(len(joint)):
            at = base + joint[g].astype(np.int64)
            out[0, g] = np.bincount(at, drawn, n_slots * cells)
            out[1, g] = np.bincount(at, pull, n_slots * cells)
        return out, leaves

    def run(them):
        total, last = None, None
        for both in them:
            out, leaves = one(both)
            total = out if total is None else total + out
            last = leaves if last is None else last + leaves
        if total is not None:
            yield total, last

    return run


def _both(a, b):
    return a[0] + b[0], None if a[1] is None else a[1] + b[1]


def best_splits(plan: Layout, hist: np.ndarray, weight: np.ndarray, total: np.ndarray, allowed: np.ndarray, least: float):
    """For every node (feature or -1, last bin of the left, gain, left weight,
    left sum) of the largest gain; the first of equal ones. ``hist`` is (2,
    arrays, nodes, cells), ``allowed`` (nodes, features)."""
    n, place = hist.shape[2], plan.place()
    best = [(-1, 0, 0.0, 0.0, 0.0)] * n
    at = np.arange(n)
    top = np.zeros(n)
    with np.errstate(all="ignore"):
        whole = np.where(weight > 0, total ** 2 / weight, 0.0)
    for f in sorted(place):
        g, factor = place[f]
        bins = plan.bins(f)
        full = hist.shape[3] // (factor * bins) * factor * bins  # no row has a joint bin past it
        parts = hist[:, g, :, :full].reshape(2, n, -1, bins, factor).sum(axis=(2, 4))
        left = np.cumsum(parts, axis=2)[:, :, :-1]
        w, s = left
        right = weight[:, None] - w
        with np.errstate(all="ignore"):
            gain = s ** 2 / w + (total[:, None] - s) ** 2 / right - whole[:, None]
        gain[(w < least) | (right < least) | ~allowed[:, f, None]] = -np.inf
        b = gain.argmax(axis=1)
        got = gain[at, b]
        for i in np.flatnonzero((got > top) & (got > 1e-12 * whole)):
            top[i] = got[i]
            best[i] = (f, int(b[i]), float(got[i] / weight[i]), float(w[i, b[i]]), float(s[i, b[i]]))
    return best


class _Held:
    """The packed rows of one task and the state of a fit."""

    def __init__(self, static: list, plan: Layout, depth: int, rate: float, seed: int):
        self.static, self.plan, self.depth, self.rate, self.seed, self.rounds = static, plan, depth, rate, seed, 0
        self.state = [_begun(rate, seed)(s) for s in static]

    def counted(self, tree: Tree, level: int, slots: dict[int, int]):
        hist, leaves = next(_histograms(self.plan, tree, level, slots)(zip(self.static, self.state)))
        return hist.reshape(2, hist.shape[1], max(1, len(slots)), -1), leaves

    def add(self, tree: Tree) -> None:
        self.rounds += 1
        step = _next(self.plan, tree, self.depth, self.rate, self.seed, self.rounds)
        self.state = [step(both) for both in zip(self.static, self.state)]

    def done(self) -> None:
        pass


class _Rows:
    """The packed rows among the executors and the state of a fit."""

    def __init__(self, blobs: DataFrame, plan: Layout, depth: int, rate: float, seed: int):
        one = BatchedSerializer(CPickleSerializer(), 1)
        self.plan, self.depth, self.rate, self.seed, self.one = plan, depth, rate, seed, one
        self.static = _arrays(blobs)._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)
        self.state = self._kept(self.static.map(_begun(rate, seed)))
        self.old = None
        self.rounds = 0

    def _kept(self, state):
        return state._reserialize(self.one).persist(StorageLevel.MEMORY_AND_DISK)

    def counted(self, tree: Tree, level: int, slots: dict[int, int]):
        found = self.static.zip(self.state).mapPartitions(_histograms(self.plan, tree, level, slots))
        if self.static.getNumPartitions() > MOST_PARTS:
            hist, leaves = found.treeReduce(_both)
        else:
            parts = found.collect()
            hist, leaves = parts[0]
            for p in parts[1:]:
                hist, leaves = _both((hist, leaves), p)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return hist.reshape(2, hist.shape[1], max(1, len(slots)), -1), leaves

    def add(self, tree: Tree) -> None:
        self.rounds += 1
        self.old = self.state
        self.state = self._kept(self.static.zip(self.state).map(_next(self.plan, tree, self.depth, self.rate, self.seed, self.rounds)))
        if self.rounds % CHECKPOINT_TREES == 0:
            self.state.checkpoint()

    def done(self) -> None:
        for r in (self.static, self.state, self.old):
            if r is not None:
                r.unpersist()


def _arrays(blobs: DataFrame):
    return blobs.rdd.map(lambda r: pickle.loads(r[0]))


def grow(rows: _Rows | _Held, plan: Layout, d: int, per_node: int, least: float, step: float) -> tuple[Tree, np.ndarray | None]:
    """One tree, and the sums of the leaves of the tree before."""
    tree, depth, rng = Tree.empty(rows.depth, step), rows.depth, np.random.default_rng((rows.seed, rows.rounds))
    hists: dict[int, np.ndarray] = {}
    before, open_ = None, [0]
    for level in range(depth):
        # of two children the lighter one is counted
        count = open_ if level == 0 else [min(pair, key=lambda i: tree.weight[i]) for pair in zip(open_[::2], open_[1::2])]
        hist, leaves = rows.counted(tree, level, {i: s for s, i in enumerate(count)})
        if level == 0:
            before = leaves
            tree.weight[0], tree.total[0] = hist[:, 0, 0].sum(axis=1)
        new = {i: hist[:, :, s] for s, i in enumerate(count)}
        for i in open_:
            if i not in new:
                rest = hists[(i - 1) // 2] - new[i + 1 if i % 2 else i - 1]
                rest[:, rest[0] < least / 2] = 0.0  # what rounding leaves of nothing
                new[i] = rest
        hists = new
        allowed = np.zeros((len(open_), d), bool)
        for a in allowed:
            a[rng.choice(d, per_node, replace=False)] = True
        best = best_splits(plan, np.stack([hists[i] for i in open_], axis=2), tree.weight[open_], tree.total[open_], allowed, least / 2)
        following = []
        for i, (f, b, gain, w, s) in zip(open_, best):
            if f >= 0:
                tree.feature[i], tree.cut[i], tree.gain[i] = f, b, gain
                for child, weight, total in ((2 * i + 1, w, s), (2 * i + 2, tree.weight[i] - w, tree.total[i] - s)):
                    tree.weight[child], tree.total[child] = weight, total
                following += [2 * i + 1, 2 * i + 2]
        open_ = following
        if not open_:
            break
    return tree, before


def boost(rows: _Rows | _Held, plan: Layout, d: int, per_node: int, least: float, rounds: int, step: float) -> list[Tree]:
    trees: list[Tree] = []
    try:
        for i in range(rounds):
            tree, before = grow(rows, plan, d, per_node, least, 1.0 if i == 0 else step)
            if trees:
                _finish(trees[-1], before)
            trees.append(tree)
            rows.add(tree)
        _finish(trees[-1], rows.counted(Tree.empty(rows.depth, 1.0), 0, {})[1])
    finally:
        rows.done()
    return trees


def _finish(tree: Tree, leaves: np.ndarray) -> None:
    """Counts and sums of squares of all nodes from those of the leaves."""
    tree.count, tree.square = leaves[0].copy(), leaves[1].copy()
    for i in range(len(tree.feature) // 2 - 1, -1, -1):
        if tree.feature[i] >= 0:
            for v in (tree.count, tree.square):
                v[i] = v[2 * i + 1] + v[2 * i + 2]


def _node_rows(plan: Layout, number: int, tree: Tree) -> list[tuple]:
    """A tree's nodes as MLlib stores them, numbered in preorder."""
    value, out = tree.value(), []

    def visit(i: int) -> int:
        at = len(out)
        out.append(None)
        w, s, q = float(tree.weight[i]), float(tree.total[i]), float(tree.square[i])
        impurity = max(0.0, (q - s * s / w) / w) if w > 0 else 0.0
        left = right = -1
        split = (-1, [], -1)
        if tree.feature[i] >= 0:
            f = int(tree.feature[i])
            split = (f, [float(plan.thresholds[f][tree.cut[i]])], -1)
            left, right = visit(2 * i + 1), visit(2 * i + 2)
        out[at] = (number, (at, float(value[i]), impurity, [w, s, q], int(round(tree.count[i])), float(tree.gain[i]), left, right, split))
        return at

    visit(0)
    return out


_NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def as_model(est, spark, d: int, plan: Layout, trees: list[Tree]):
    """The trees as an MLlib model, in the form that it stores: a model of two
    rows gives the parameters."""
    from pyspark.ml.classification import GBTClassificationModel
    two = spark.createDataFrame([(Vectors.dense([float(i)] * d), float(i), 1.0) for i in (0, 1)], ["features", "label", "weight"])
    path = shared_path(spark, "models", f"boosted-{uuid.uuid4().hex}")
    est.copy({est.maxIter: 1, est.subsamplingRate: 1.0}).fit(two).write().save(f"{path}/two")
    meta = json.loads(spark.read.text(f"{path}/two/metadata").first()[0])
    meta["paramMap"] |= {"maxIter": len(trees), "subsamplingRate": est.getSubsamplingRate()}
    meta["numTrees"] = len(trees)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/whole/metadata")
    own = spark.read.parquet(f"{path}/two/treesMetadata")
    (id_, metadata, weight) = own.columns
    one = own.first()[metadata]
    weights = [(i, one, float(t.step)) for i, t in enumerate(trees)]
    spark.createDataFrame(weights, own.schema).coalesce(1).write.parquet(f"{path}/whole/treesMetadata")
    nodes = [r for i, t in enumerate(trees) for r in _node_rows(plan, i, t)]
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(f"{path}/whole/data")
    return GBTClassificationModel.load(f"{path}/whole")


def fit_boosted(est, df: DataFrame):
    """MLlib's ``GBTClassifier`` ``est`` fitted on ``df`` (features, label and
    weight), which is read three times."""
    spark = df.sparkSession
    rows = df.select(vector_to_array("features").alias("_x"), F.col("label").cast("double").alias("_y"), F.col(est.getWeightCol()).cast("double").alias("_w"))
    rows = rows.where(F.col("_w") > 0)
    first = rows.select(F.size("_x")).first()
    d = first[0] if first else 0
    if not 0 < d <= MOST_FEATURES:
        return est.fit(df)
    plan = layout(find_thresholds(rows, d, est.getMaxBins()))
    if not plan.packs:
        return est.fit(df)  # no feature tells rows apart
    run, n_used, kind = _binned(plan, d)
    groups = stored(rows.mapInArrow(run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "boosting-rows")
    n = groups.count()
    cores = spark.sparkContext.defaultParallelism
    parts = min(n // LEAST_ROWS + 1, cores * -(-n // (cores * MOST_ROWS)))
    blobs = stored(groups.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_packed(plan, n_used, kind), "blob binary"), "boosting-arrays")
    least = rows.agg(F.min("_w")).first()[0]
    per_node = d if est.getFeatureSubsetStrategy() == "all" else max(1, int(np.ceil(float(est.getFeatureSubsetStrategy()) * d)))
    of = (plan, est.getMaxDepth(), est.getSubsamplingRate(), est.getSeed() % 2 ** 32)
    loop = (plan, d, per_node, least, est.getMaxIter(), est.getStepSize())
    if n <= ONE_TASK:
        trees = _arrays(blobs).coalesce(1).mapPartitions(lambda them: boost(_Held(list(them), *of), *loop)).collect()
    else:
        trees = boost(_Rows(blobs, *of), *loop)
    return as_model(est, spark, d, plan, trees)
