import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import periodic_runs as R

from .helpers import awkward_texts, documents, empty, words

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    """Every maximal stretch of each period; the smallest period of a stretch counts."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def contract(doc_id, text):
    w, n = words(text), 0
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *first, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        x = []
        while len(x) < rnd.choice([5, 30, 200, 400]):
            kind = rnd.randrange(3)
            part = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randint(1, rnd.choice([3, 12, 70])))]
            x += part * rnd.choice([1, 2, 3, 9]) if kind else part
            if kind == 2:
                x += part[:rnd.randint(0, len(part))]
        assert [tuple(r) for r in R.runs(np.array(x))] == sorted(brute(x), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("values", [2, 1 << 20])
def test_zero_mismatches_are_exact(values):
    rnd = np.random.default_rng(1)
    for b in (2, 8, 64):
        blocks, windows = rnd.integers(0, 2, (40, b)), rnd.integers(0, 2, (40, 3 * b - 1))
        windows[::2, 1:1 + b] = blocks[::2]
        windows[1::4, -b:] = blocks[1::4]
        windows[3::4, 1:1 + b] = blocks[3::4]
        windows[3::4, b] ^= 1
        scale = values - 1
        got = R.zero_mismatches(blocks * scale, windows * scale, values)
        want = np.array([[(windows[i, k:k + b] == blocks[i]).all() for k in range(2 * b)] for i in range(40)])
        assert (got == want).all() and want.any()


def test_square_sums_need_several_primes():
    """Numbers whose squared differences sum to a multiple of the first prime don't match."""
    p = R.PRIMES[0][0]
    k = next(k for k in range(1, p) if int(round((p - k * k) ** 0.5)) ** 2 == p - k * k) if p % 4 == 1 else None
    if k:
        m = int(round((p - k * k) ** 0.5))
        assert not R.zero_mismatches(np.array([[0, 0]]), np.array([[k, m, 1, 1, 1]]), max(k, m))[0, 0]


def test_one_long_run_and_deep_nesting():
    assert [tuple(r) for r in R.runs(np.zeros(100_000, np.int64))] == [(0, 100_000, 1)]
    x = [0] * 20 + [1]
    for _ in range(4):
        x = x * 5 + [len(x)]
    assert [tuple(r) for r in R.runs(np.array(x[:3000]))] == sorted(brute(x[:3000]), key=lambda r: (r[0], r[2]))
    fib = [0], [0, 1]
    while len(fib[1]) < 2000:
        fib = fib[1], fib[1] + fib[0]
    assert [tuple(r) for r in R.runs(np.array(fib[1]))] == sorted(brute(fib[1]), key=lambda r: (r[0], r[2]))
    with pytest.raises(ValueError):
        R.runs(np.zeros(9), 4)


def periodic_texts():
    rnd = random.Random(2)
    w = ["".join(rnd.choice("abc") for _ in range(3)) for _ in range(60)]
    return ["a " * 12, "a " * 11, "a b c d e f " * 2, "a b c d e f\n" * 2 + "g", "x " + "é ß " * 9 + "é y", " ".join(w * 7), " ".join(w * 2 + w[:5] + w * 3), "z z z z z z " * 30 + "b " * 30]


def test_against_the_contract(spark, tmp_path):
    texts = [t if t is None or len(t) < 20_000 else t[:20_000] for t in awkward_texts()] + periodic_texts()
    df = documents(spark, texts * 4, extra=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(contract(r.doc_id, r.text) for r in df.collect())
    assert rows(R.op12_periodic_runs(spark, str(tmp_path))) == want


def test_registered_table_against_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in R.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 10
    short = [r for r in docs if len(r.text or "") < 8_000]
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: contract(r.doc_id, r.text) for r in short}


def test_general_form_and_empty(spark):
    df = spark.createDataFrame([("k", "a b " * 8 + "c"), ("l", None), ("l", None)], "key string, body string")
    got = sorted(R.periodic_runs(df, "key", "body").collect(), key=lambda r: r.key)
    assert [(r.key, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [("k", 17, [(0, 16, 2)], "a b c"), ("l", 0, [], ""), ("l", 0, [], "")]
    assert R.periodic_runs(empty(spark)).collect() == []
