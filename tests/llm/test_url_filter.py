import random

import numpy as np
import pytest

from ledgerlens.llm import url_filter as U

URLS = [
    "http://a.example.org/es/1", "https://example.org/es", "https://example.org/en/12", "https://EXAMPLE.org/en/2", "https://notexample.org/es/",
    "http://x.com/fr/?a", "http://x.com/de/#b", "http://x.com/de", "ftp://y.net/fr/", "no scheme", "", None, "http://", "http://org/", "http://org",
    "http://a.b.c.d.org?x=/", "http://x.com/fr/://y.org/", "://z.com/de/k", "http://x.com:80/de/", "http://x.org/" + "p/" * 3000, "http://" + "s." * 500 + "com/de/",
    "http://x.com/d\ne/", "http://x.com/fr/", "http://x.com/fr/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = max([(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)], default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bits", [16, 1])
def test_against_brute_force(spark, bits):
    pages = spark.createDataFrame([(i % 20 or None, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    got = U.filter_urls(pages, listed, bits_per_key=bits)
    want = sorted(str((i % 20 or None, *brute(u, U.RULES))) for i, u in enumerate(URLS))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_random_rules(spark):
    rnd = random.Random(1)
    part = lambda: rnd.choice(["a", "b", "c", "d"])
    rules = {(".".join(part() for _ in range(rnd.randint(1, 3))), "/" + part() * rnd.randint(0, 2)): rnd.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ["http://" + ".".join(part() for _ in range(rnd.randint(1, 4))) + "/" + "".join(part() for _ in range(rnd.randint(0, 4))) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((i, *brute(u, rules))) for i, u in enumerate(urls))


def test_empty_sides_and_both_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in U.filter_urls(pages, none).collect()] == ["allow"]
    assert U.filter_urls(pages.limit(0), none).collect() == []
    both = spark.createDataFrame([("com", "/de/", "allow"), ("COM", "/de/", "block"), (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert [r.verdict for r in U.filter_urls(pages, both).collect()] == ["block"]


def test_filter_has_no_false_negatives_and_few_hits(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) AS rule")
    words = U.bloom_words(keys, "rule", 64)
    hashes = lambda df: [np.array(x, np.int64) for x in zip(*[tuple(r) for r in df.selectExpr("xxhash64(rule)", "xxhash64(rule, 7)").collect()])]
    assert U.bloom_test(words, *hashes(keys)).all()
    assert U.bloom_test(words, *hashes(spark.range(2000).selectExpr("concat('x', id) AS rule"))).mean() < 0.05
