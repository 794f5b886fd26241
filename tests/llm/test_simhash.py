import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash as S
from ledgerlens.llm.components import components

from .helpers import documents, empty, words


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_documents_against_brute_force(spark):
    df = documents(spark)
    rows = df.collect()
    fps = [fingerprint(r.text) for r in rows]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_copies(df).collect()}
    assert got == {r.doc_id: ("%016x" % fps[k], root[k]) for k, r in enumerate(rows)}


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("shingle", [1, 3])
def test_long_texts_go_in_parts(monkeypatch, most, shingle):
    monkeypatch.setattr(S, "TEXT_BYTES", most)
    texts = ["", " ", "a", "a b", "a b c", " lead and  trail\n", "x" * 300, "one two\tthree four five " * 9, "é ß " * 40, "w" * 70 + " a b c d"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = S._fingerprints(np.frombuffer(b"".join(raw), np.uint8), offs, shingle).tolist()
    for t, fp in zip(texts, got):
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]).encode(), 42) for i in range(len(w) - shingle + 1)] or ([xxhash.xxh64_intdigest(" ".join(w).encode(), 42)] if w else [])
        assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), t


@pytest.mark.parametrize("max_bits,long", [(1, 4096), (2, 4096), (2, 5), (3, 50)])
def test_links_connect_what_is_near(spark, monkeypatch, max_bits, long):
    monkeypatch.setattr(S, "LONG", long)  # with 5, the dense ones' lists are cut
    rnd = random.Random(max_bits)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):  # chains of near ones
            fps.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    dense = rnd.getrandbits(64) & ~0xFFFF  # a long list: many near ones that share six bytes
    fps |= {dense | rnd.getrandbits(12) for _ in range(700)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(df, max_bits).collect()]
    at = {x: i for i, x in enumerate(fps)}
    a = np.array(fps, np.uint64)
    true = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= max_bits)]
    assert roots(len(fps), [(at[x], at[y]) for x, y in edges]) == roots(len(fps), true)
    assert len(edges) < 80 * len(fps)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_sharing_enough_bytes_means_meeting_in_a_list(max_bits):
    for other in range(1 << 8):  # positions in which a pair differs
        differ = {p for p in range(8) if other >> p & 1}
        meets = any(differ <= set(c) for c in S.coarse_choices(max_bits))
        assert meets or len(differ) > max_bits


def test_tally_rejects_pairs():
    """A list's members share four bytes; pairs that share five or fewer of eight
    don't reach the minimum, and of those that do not all agree in their bits."""
    rnd = np.random.default_rng(1)
    fps = rnd.integers(0, 1 << 32, 300, dtype=np.uint64)
    fps[1::3] = fps[::3] ^ np.uint64(0b11)  # six shared bytes, two bits
    fps[2::3] = fps[::3] ^ np.uint64(0xFFFF)  # six shared bytes, sixteen bits
    x = fps[:, None] ^ fps[None, :]
    want = (x[..., None].view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    assert (S._shared_bytes(x) == want).all()
    retained, near = want >= 6, np.bitwise_count(x) <= 2
    assert (~retained & np.triu(np.ones_like(retained), 1).astype(bool)).any() and (retained & ~near).any()
    assert (S._linked(x, 2) == near).all()


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(400, pairs)
    assert all(got.get(x, x) == want[x] for x in range(400)) and 7 in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    df = documents(spark, extra=True)
    got = S.one_of_each(df)
    assert got.columns == df.columns
    near = S.near_copies(df).collect()
    n_groups = len({fingerprint_root for fingerprint_root in _groups(df)})
    rows = got.collect()
    assert len(rows) == n_groups
    first = {r.component_id for r in near if r.component_id is not None}
    assert {r.doc_id for r in rows if r.doc_id is not None} == first


def _groups(df):
    fps = [fingerprint(r.text) for r in df.select("text").collect()]
    return roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def test_empty(spark):
    assert S.near_copies(empty(spark)).collect() == [] and S.one_of_each(empty(spark)).collect() == []


def test_large_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text many times").otherwise(F.concat(F.lit("w "), F.md5(F.col("id").cast("string")))).alias("text"))
    got = {r.doc_id: r.component_id for r in S.near_copies(df).collect()}
    assert all(got[i] == 0 for i in range(0, 3000, 3))
