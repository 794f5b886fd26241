"""Embedding near-duplicates (operator 4): Euclidean p-stable hashing.

Normalised vectors are projected on random normal directions, shifted,
divided by a width and rounded down; ``k`` such numbers and the label are a
bucket, in each of ``L`` tables. Vectors that share a bucket are compared by
exact cosine in double precision. At a distance c a number agrees with
probability p(c) = 1 - 2 N(-w/c) - 2 / (sqrt(2 pi) w/c) (1 - exp(-w^2 / 2 c^2));
``k`` is chosen so that an unrelated vector shares a bucket with less than one
in four others, and ``L`` so that a pair at the threshold is found with
probability ``recall``.

Equal vectors of a label are one class, so copies cost one row. A pair counts
in the first table in which its buckets agree, so sums over tables count each
link once and no pair leaves its task. Buckets of over ``BLOCK`` members are cut
into blocks, compared block against block in tasks of their own. Links leave a
bucket as counts and as a spanning forest.

Edge cases: vectors that are null, empty, zero or hold null, NaN or infinite
components, and vectors without a label, link with nothing; so do vectors of
unequal length. Repeated rows are vectors of their own. An empty table gives
an empty result. Other columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, materialize, one_array, table
from .components import components

WIDTH = 2.5
BLOCK = 1024


def agreement(c: float, w: float = WIDTH) -> float:
    """The probability that one rounded projection agrees at distance ``c``."""
    r = w / c
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(k, L) for ``n`` vectors that can meet."""
    near, far = agreement(math.sqrt(2 - 2 * threshold)), agreement(math.sqrt(2))
    k = max(4, math.ceil(math.log(4 * max(n, 2)) / math.log(1 / far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(31))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _buckets(v: np.ndarray, label: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table, as n x tables longs."""
    dim = v.shape[1]
    rng = np.random.default_rng([seed, dim])
    a, b = rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)
    q = np.floor((_unit(v) @ a + b) / WIDTH).astype(np.int64).reshape(len(v), tables, k)
    h = _mix(_mix(np.full((len(v), tables), dim, np.uint64), np.broadcast_to(label[:, None], (len(v), tables))), np.broadcast_to(np.arange(tables), (len(v), tables)))
    for j in range(k):
        h = _mix(h, q[:, :, j])
    return np.maximum(h, 1).view(np.int64)  # 0 stands for no bucket


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest position in each one's component of a boolean matrix."""
    root = np.arange(len(linked))
    while True:
        new = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
                 recall: float = 0.98, seed: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    v = F.col("v")
    # single-precision components stay so until they are compared, in double precision
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    usable = (F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    clean = F.transform(v, lambda x: x + F.lit(0.0).cast(kind))
    rows = rows.select("vec_id", "label", "usable", F.when(F.col("usable"), clean).alias("v"))
    rows = rows.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64("v", "label", F.lit(9))})
    classes = (rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
               .withColumn("cid", F.monotonically_increasing_id()))
    classes = materialize(classes, "vector-classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables = plan(most, threshold, recall)

    def signed(batches):
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                part = batch.take(at)
                codes = _buckets(_matrix(part.column(2)), part.column(1).to_numpy(), k, tables, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1)), tables).cast(pa.list_(pa.int64()))], ["cid", "codes"])

    codes = materialize(classes.select("cid", F.xxhash64("label").alias("label"), "v").mapInArrow(signed, "cid long, codes array<long>"), "vector-codes")
    posted = codes.select("cid", F.posexplode("codes").alias("t", "code"))
    shared = posted.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    posted = materialize(posted.join(shared, "code"), "shared-buckets")
    # of each vector, the buckets that it shares: no other can be one in which a pair meets
    held = posted.groupBy("cid").agg(F.collect_list(F.struct("t", "code")).alias("held"))
    entries = posted.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # block against block: a member goes to every pair of blocks that has its own
    mine = F.pmod(F.xxhash64("cid", F.lit(4)), F.col("blocks")).cast("int")
    entries = (entries.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("code", "t", "cid", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    known = materialize(classes.select("cid", "copies", "v").join(held, "cid"), "shared-vectors")
    members = entries.join(known, "cid").select("code", "i", "j", "t", "cid", "copies", "mine", "v", "held.t", "held.code").toDF(
        "code", "i", "j", "t", "cid", "copies", "mine", "v", "tables", "codes")

    def linked(batches):
        for t, edges in complete_runs(batches, ["code", "i", "j"]):
            t = t.combine_chunks()
            cid, copies, mine, table_no = (t[x].to_numpy() for x in ("cid", "copies", "mine", "t"))
            i, j = t["i"].to_numpy(), t["j"].to_numpy()
            vec, all_codes = one_array(t["v"]), _codes(one_array(t["tables"]), one_array(t["codes"]), tables)
            size = np.diff(edges)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            two = edges[:-1][size == 2]
            if len(two):
                a, b = _unit_rows(vec, two), _unit_rows(vec, two + 1)
                for d in set(a) & set(b):
                    (pa_, va), (pb_, vb) = a[d], b[d]
                    both, x, y = np.intersect1d(pa_, pb_, return_indices=True)
                    near = (va[x] * vb[y]).sum(axis=1) >= threshold
                    p = two[both]
                    earlier = ((all_codes[p] == all_codes[p + 1]) & (all_codes[p] != 0) & (np.arange(tables) < table_no[p][:, None])).any(axis=1)
                    near &= (i[p] == j[p]) | (mine[p] != mine[p + 1])
                    p, first = p[near], ~earlier[near]
                    out.append((cid[p], np.where(first, copies[p + 1], 0), np.minimum(cid[p], cid[p + 1])))
                    out.append((cid[p + 1], np.where(first, copies[p], 0), np.minimum(cid[p], cid[p + 1])))
            for s, e in zip(edges[:-1][size > 2], edges[1:][size > 2]):
                whole = np.argsort(cid[s:e], kind="stable") + s
                for places, u in _unit_rows(vec, whole).values():  # a clash of hashes can bring lengths together
                    order = whole[places]
                    near = u @ u.T >= threshold
                    np.fill_diagonal(near, False)
                    if i[s] != j[s]:
                        near &= mine[order][:, None] != mine[order][None, :]
                    c = all_codes[order]
                    counted = near.copy()
                    for q in range(int(table_no[s])):
                        counted &= (c[:, q][:, None] != c[:, q][None, :]) | (c[:, q] == 0)[:, None]
                    root = _forest(near)
                    some = near.any(axis=1)
                    out.append((cid[order][some], (counted @ copies[order])[some], cid[order][root][some]))
            if out:
                x = [np.concatenate(z).astype(np.int64) for z in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in x], ["cid", "links", "root"])

    found = materialize(members.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j").mapInArrow(linked, "cid long, links long, root long"), "vector-links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select("cid", "root"), "cid", "root").select(F.col("node").alias("cid"), "root")
    named = classes.select("cid", "k1", "k2", "least", "copies").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(counts, "cid", "left")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = named.join(smallest, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked_rows = rows.where("usable").select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _codes(table_no: pa.Array, codes: pa.Array, tables: int) -> np.ndarray:
    """The shared buckets of each row by table, 0 where there is none."""
    out = np.zeros((len(codes), tables), np.int64)
    n = np.diff(codes.offsets.to_numpy())
    out[np.repeat(np.arange(len(codes)), n), table_no.flatten().to_numpy()] = codes.flatten().to_numpy()
    return out


def _unit_rows(column: pa.Array, at: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (places in ``at``, unit vectors)."""
    part = column.take(pa.array(at))
    dims = np.diff(part.offsets.to_numpy())
    out = {}
    for d in np.unique(dims):
        places = np.flatnonzero(dims == d)
        out[int(d)] = (places, _unit(_matrix(part.take(pa.array(places)))))
    return out


def op4_vector_links(spark, sf_dir) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
