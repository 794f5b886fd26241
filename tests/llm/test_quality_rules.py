import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as Q

from .helpers import documents, empty, words


def brute(text):
    text, w = text or "", words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    n, again = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            again |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), failed


def test_statistics_against_brute_force(spark):
    df = documents(spark, extra=True)
    texts = Counter((r.doc_id, *brute(r.text)) for r in df.collect())
    got = Q.judge(df, []).collect()
    assert Counter(tuple(r)[:7] for r in got) == texts
    assert all(r.kept == (not r.base_failed) for r in got)


def test_verdicts_can_be_filtered(spark):
    """A filter on the result must not repeat the statistics: 200 texts, some of 30,000 words, in seconds."""
    docs = documents(spark).crossJoin(spark.range(8)).select((F.col("doc_id") * 8 + F.col("id")).alias("doc_id"), "text")
    judged = Q.judge(docs, [[("symbol_ratio", ">", 0.5)]])
    plan = judged.where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == judged._jdf.queryExecution().optimizedPlan().toString().count("sort_array")
    want = sorted(r.doc_id for r in judged.collect() if r.kept)
    assert sorted(r.doc_id for r in judged.where("kept").collect()) == want and want


def labelled(spark, n=900):
    """Two kinds of bad rows that no single condition separates from the good."""
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60 + i % 50)]
        if bad and i % 2:
            w = [x[:3] + "%%" for x in w]
        elif bad:
            w = [x[:4] + "!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 0, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_are_learned_and_precise(spark):
    docs, labels = labelled(spark)
    rules = Q.learned(docs, labels)
    assert rules and all(1 <= len(r) <= 3 for r in rules)
    kept = {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()}
    assert sum(kept[i] == (i % 3 != 0) for i in kept) >= 0.99 * len(kept)
    held = Q.keep_good(docs.withColumn("_w", F.lit("x")), rules)
    assert held.columns == ["doc_id", "text", "_w"] and held.count() == sum(kept.values())


def test_no_labels_no_rules(spark):
    docs, labels = labelled(spark, 60)
    assert Q.learned(docs, labels.limit(0)) == []
    assert Q.learned(docs, labels.withColumn("quality", F.lit(1))) == []


def test_ordered_expression(spark):
    rules = [[("symbol_ratio", ">", 0.5)], [("mean_word", "<=", 2.0), ("upper_ratio", ">", 0.1)]]
    assert str(Q.rejects(rules)).count("WHEN") == 2


def test_empty(spark):
    assert Q.judge(empty(spark), []).collect() == [] and Q.keep_good(empty(spark), []).collect() == []


def test_no_python_on_the_executors(spark):
    plan = Q.judge(documents(spark), [[("symbol_ratio", ">", 0.5)]])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
