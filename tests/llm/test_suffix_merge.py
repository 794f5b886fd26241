import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import suffix_merge as M

from .helpers import documents, empty


def cover(texts, width):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if n[b[i:i + width]] > 1:
                gone[i:i + width] = True
        out.append(gone)
    return raw, out


def brute(texts, width=200):
    rows = []
    for b, gone in zip(*cover(texts, width)):
        rows.append((len(b), int(gone.sum()), len(M._spans(gone)[0]), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return rows


@pytest.mark.parametrize("hot", [M.HOT, 2])
def test_documents_against_brute_force(spark, hot):
    df = documents(spark, extra=True).repartition(5)
    rows = df.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *x)) for r, x in zip(rows, brute([r.text for r in rows])))
    got = M.cut_spans(df, hot=hot)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def passages(seed=3):
    """Texts that share passages in many ways, few letters, also inside one text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randint(40, 150)) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else prose(rnd.randint(1, 80)) for _ in range(rnd.randint(1, 6))]
        t = " ".join(parts)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(t))
            t = t[:at] + "#" + t[at + 1:]
        texts.append(t)
    return texts + ["ab" * 400, "ab" * 300 + "b", "a" * 1000, "a" * 199, "a" * 200]


@pytest.mark.parametrize("hot", [M.HOT, 20])
def test_shared_passages(spark, hot):
    texts = passages()
    rows = list(enumerate(texts))
    got = {r[0]: tuple(r)[1:] for r in M.cut_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_merge_equals_sorting_all_suffixes():
    """The interleave and the common prefixes are those of one sort of all suffixes."""
    rng = np.random.default_rng(0)
    depth = 4
    shards = []
    for _ in range(3):
        strings, starts = [], []
        for _ in range(20):
            starts.append(len(strings))
            strings += list(rng.integers(1, 4, rng.integers(1, 9))) + [0]
        shards.append((np.array(strings), np.array(starts)))
    suffixes = []
    transforms = []
    for z, (s, starts) in enumerate(shards):
        order, t = M.shard_transform(s, starts, depth)
        transforms.append(t)
        for i in order:
            stop = i + int(np.argmin(s[i:] != 0))
            suffixes.append((tuple(s[i:stop][:depth]), z))
    interleave, lcp = M.merge_transforms(transforms, depth)
    merged = sorted(x for x, _ in suffixes)
    per_shard = [iter([x for x, y in suffixes if y == z]) for z in range(3)]
    assert [next(per_shard[z]) for z in interleave] == merged
    for j in range(1, len(merged)):
        a, b = merged[j - 1], merged[j]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert lcp[j] == same


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_against_counting(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 100, 400, dtype=np.uint8)
    parts = []
    for _ in range(40):
        a = rng.integers(0, 300)
        p = base[a:a + rng.integers(20, 100)].copy()
        if rng.random() < 0.5:
            p[rng.integers(0, len(p))] ^= 1
        parts.append(p)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = M.repeated_windows(np.concatenate(parts), offs, width=20, symbol=5, shards=3)
    n = Counter(bytes(p[i:i + 20]) for p in parts for i in range(len(p) - 19))
    want = np.concatenate([[i + 20 <= len(p) and n[bytes(p[i:i + 20])] > 1 for i in range(len(p))] for p in parts])
    assert (got == want).all()


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(1)
    lens = [0, 0, 10, 199, 200, 201, 5000, 0, 300_000, 0]
    buf = rng.integers(97, 101, sum(lens), dtype=np.uint8)
    offs = np.concatenate([[0], np.cumsum(lens)])
    _, place, lo, hi = M.anchors(buf, offs)
    got = np.zeros(len(buf), int)
    for a, b in zip(lo, hi):
        got[a:b + 1] += 1
    want = np.concatenate([np.arange(n) + 200 <= n for n in lens]) if sum(lens) else []
    assert (got == np.array(want, int)).all() and ((place >= hi) & (place <= lo + 200 - M.GRAM)).all()


def test_without_repeats(spark):
    df = documents(spark, extra=True)
    got = M.without_repeats(df)
    assert got.columns == df.columns and got.count() == df.count()
    rows = df.select("doc_id", "text").collect()
    want = []
    for r, (b, gone) in zip(rows, zip(*cover([r.text for r in rows], 200))):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        want.append(str((r.doc_id, None if r.text is None else kept)))
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "text").collect()) == sorted(want)
    assert got.where(F.col("_text") == F.concat(F.lit("x"))).count() >= 0


def test_empty(spark):
    assert M.cut_spans(empty(spark)).collect() == [] and M.without_repeats(empty(spark)).collect() == []
