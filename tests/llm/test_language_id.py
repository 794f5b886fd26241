import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as L

from .helpers import awkward_texts, documents, empty


def labelled(spark, n=160):
    rnd = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ung", "ach"], "cc": ["éa", "oi", "eau", "què"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i in range(n) for lang in [sorted(parts)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), word


def test_held_out_accuracy(spark):
    docs, word = labelled(spark)
    model = L.learn(docs.where("doc_id % 4 <> 0"))
    got = L.predict(docs, model, [F.col("doc_id"), F.col("lang")]).where("doc_id % 4 = 0").collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got) and len(got) == 40
    short = docs.sparkSession.createDataFrame([(i, word(x).upper() + "!", x) for i, x in enumerate(["aa", "bb", "cc"] * 10)], "doc_id long, text string, lang string")
    right = [r.lang == r.lang_pred for r in L.predict(short, model, [F.col("lang")]).collect()]
    assert sum(right) >= 27


def brute(filter_, prior, text):
    """Counts n-grams of one text alone, one by one."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = low.split()
    if not words:
        return "und", 0.0
    plain = " " + " ".join(words) + " "
    grams = [plain[i:i + n] for n in L.SIZES for i in range(len(plain) - n + 1) if " " not in plain[i + 1:i + n - 1] and not (n == 2 and plain[i:i + 2] == "  ")]
    total, hits = 0, np.zeros(len(filter_.langs))
    for g in grams:
        h = np.full(1, len(g), np.uint64)
        for c in g:
            h = (h ^ np.uint64(ord(c))) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        total += 1
        m = int(filter_.languages(h)[0])
        hits += [m >> i & 1 for i in range(len(filter_.langs))]
    f = filter_.false_rate()
    real = np.clip((hits - total * f) / (1 - f), 0, None)
    best = max(range(len(real)), key=lambda i: (real[i], prior[i], -i))
    return filter_.langs[best], min(1.0, real[best] / total)


@pytest.mark.parametrize("chars", [1, 8, 100, 5000])
def test_long_texts_go_in_parts(monkeypatch, chars):
    rnd = np.random.default_rng(4)
    filter_ = L.Filter(["aa", "bb"], 1 << 10)
    for i in range(2):
        filter_.add(i, rnd.integers(0, 1 << 62, 150).astype(np.uint64))
    texts = [t for t in awkward_texts() if t is None or len(t) < 9_000] + ["日本語、テスト。" * 60, "ΑΣ. ΣΑΣ ΟΔΟΣ\tΟΔΟΣ " * 30, "", None, " 1 2 3 "]
    whole = filter_.decide(texts, np.ones(2))
    monkeypatch.setattr(L, "PART_CHARS", chars)
    parts = filter_.decide(texts, np.ones(2))
    assert whole[0] == parts[0] and whole[1].tolist() == parts[1].tolist() and whole[1].max() > 0
    assert len(list(L._parts(texts))) > 1 and all(len(t) < chars + 5100 for _, held in L._parts(texts) for t in held)


def test_batches_agree_with_one_by_one(spark):
    docs, _ = labelled(spark)
    filter_, prior = L.learn(docs)
    texts = awkward_texts()[:15] + awkward_texts()[16:] + [r.text for r in docs.limit(5).collect()]
    lang, score = filter_.decide(texts, prior)
    for t, x, s in zip(texts, lang, score):
        want = brute(filter_, prior, t)
        assert x == want[0] and abs(s - want[1]) < 1e-9


def test_awkward_rows(spark):
    docs, _ = labelled(spark)
    df = documents(spark, extra=True)
    got = L.predict(df, L.learn(docs), [F.col("doc_id")]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == df.count() and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 6))
    assert all(r.lang_pred in ("aa", "bb", "cc", "und") and 0 <= r.score <= 1 for r in got)
    assert L.predict(empty(spark), L.learn(docs), [F.col("doc_id")]).collect() == []


def test_nothing_to_learn(spark):
    docs, _ = labelled(spark, 9)
    model = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, model, [F.col("doc_id")]).collect()} == {"und"}


def test_filter_finds_all_it_has():
    f = L.Filter(["a", "b"], 1 << 12)
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    f.add(1, h)
    assert (f.languages(h) & 2 == 2).all() and (f.languages(h) & 1 == 0).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert abs((f.languages(other) & 2 == 2).mean() - f.false_rate()[1]) < 0.01


def test_more_languages_than_a_word_has_bits(spark):
    rnd = random.Random(4)
    parts = {f"l{k:03}": [chr(0x4E00 + 8 * k + j) for j in range(8)] for k in range(70)}  # letters of its own
    text = lambda x: " ".join("".join(rnd.choices(parts[x], k=4)) for _ in range(12))
    docs = spark.createDataFrame([(i, text(x), x) for i, x in enumerate([*parts] * 8)], "doc_id long, text string, lang string")
    model = L.learn(docs.where("doc_id % 8 <> 0"), n_rows=1 << 18)
    assert model[0].masks.shape == (1 << 18, 2)
    got = L.predict(docs, model, [F.col("doc_id"), F.col("lang")]).where("doc_id % 8 = 0").collect()
    assert len(got) == 70 and {r.lang for r in got} > {"l064", "l066", "l068"} and all(r.lang == r.lang_pred and r.score > 0 for r in got)


def test_filter_of_many_languages_equals_one_filter_a_language():
    rng = np.random.default_rng(3)
    grams = [rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(130)]
    wide = L.Filter([f"{i:03}" for i in range(130)], 1 << 14)
    for i, g in enumerate(grams):
        wide.add(i, g)
    assert wide.masks.shape == (1 << 14, 3)
    asked = np.concatenate([*grams, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)])
    mask, rates = wide.languages(asked), wide.false_rate()
    for i, g in enumerate(grams):
        one = L.Filter(["x"], 1 << 14)
        one.add(0, g)
        assert wide._bits(mask, i).tolist() == one.languages(asked).tolist() and rates[i] == one.false_rate()[0]
