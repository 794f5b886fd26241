import re
from collections import Counter

import pytest

from ledgerlens.llm import license_scan as L
from ledgerlens.llm.license_rules import BASE, BASE_PHRASES, NAME, NOTICE, TAG, Rule, default_rules

from .helpers import documents, empty

SF = "/root/testdata/sf0.001"
EXAMPLES = {
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "// SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa-4.0", "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0", "This is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "GPLv2 only": "gpl-2.0", "LGPLv2.1": "lgpl-2.1", "see CC BY-NC 4.0 here": "cc-by-nc-4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
    "http://creativecommons.org/licenses/by-nd/2.5/": "cc-by-nd-2.5", "under the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0", "released under MPL 1.1": "mpl-1.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "BSD 3-Clause License": "bsd-3-clause", "distributed under a FreeBSD License": "bsd-2-clause", "https://www.apache.org/licenses/LICENSE-2.0.txt": "apache-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0", "This is free and unencumbered software released into the public domain.": "unlicense",
    "You just DO WHAT THE FUCK YOU WANT TO.": "wtfpl", "All rights reserved": "copyright", "© Copyright (c) 2019": "copyright", "dedicated to the public domain": "public-domain",
    "PSF License": "python", "MIT/X11 License": "mit", "under a CreativeML Open RAIL-M license": "openrail", "EUPL-1.2": "eupl-1.2", "Open Government Licence v3.0": "ogl-3.0",
}


def brute_base(text):
    """Words, places of the base phrases and labels, by the contract's words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for phrase, label in BASE_PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def scanned(texts, **options):
    s = L.Scanner(default_rules(), **options)
    out = []
    for t in texts:
        raw = t.encode()
        import numpy as np
        x, offs, _ = L.normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        text = " " + x.tobytes().decode("latin-1")
        found = s.detections(text)
        out.append([(*d, ok) for d, ok in zip(found, s.kept(found))])
    return s, out


@pytest.mark.parametrize("text,label", EXAMPLES.items())
def test_examples(text, label):
    s, (found,) = scanned([f"Some words before. {text} and after it."])
    kept = {s.rules[i].label for _, _, i, ok in found if ok}
    assert label in kept


def test_hundreds_of_rules_and_their_keywords():
    rules = default_rules()
    assert len(rules) > 400 and len({r.name for r in rules}) == len(rules) and [r.priority for r in rules] == sorted(r.priority for r in rules)
    texts = [" ".join(EXAMPLES), *EXAMPLES, *[f"x {a} {b} y" for a in EXAMPLES for b in list(EXAMPLES)[:6]]]
    assert scanned(texts)[1] == scanned(texts, gated=False)[1]  # a gate loses nothing


def test_containment_by_priority():
    rules = [Rule("a", "a", TAG, "b c", ("b",)), Rule("b", "b", NOTICE, "a b c d", ("a",)), Rule("c", "c", NAME, "c d|a", ("c", "a")), Rule("d", "d", NAME, "d e", ("e",))]
    s = L.Scanner(rules)
    found = s.detections(" a b c d e ")
    assert [(x[0], x[1], s.rules[x[2]].name, ok) for x, ok in zip(found, s.kept(found))] == [
        (0, 1, "c", False), (0, 4, "b", True), (1, 2, "a", True), (2, 2, "c", False), (3, 2, "d", True)]


def quadratic(found, priority):
    """Containment, one detection against all."""
    kept = []
    for s, n, i in sorted(found, key=lambda d: (priority(d[2]), d[0], -d[1], d[2])):
        if not any(a <= s and s + n <= a + m for a, m, _ in kept):
            kept.append((s, n, i))
    return kept


def test_containment_against_quadratic_form():
    import random
    rnd = random.Random(5)
    rules = [Rule(str(i), str(i), p, "x", ("x",)) for i, p in enumerate([10, 20, 20, 30, 90])]
    s = L.Scanner(rules)
    for _ in range(200):
        found = sorted({(rnd.randrange(30), rnd.randrange(1, 9), rnd.randrange(5)) for _ in range(25)})
        got = [d for d, ok in zip(found, s.kept(found)) if ok]
        assert sorted(got) == sorted(quadratic(found, lambda i: rules[i].priority))


def with_licenses():
    return ["GNU General Public License\tgnu general\npublic LICENSE, mit licenses", "CC BY CC-BY cc by ccby", "é MIT license" * 3, "mit license " * 40_000, *EXAMPLES]


def test_against_brute_force_on_awkward_texts(spark, tmp_path):
    from .helpers import awkward_texts
    df = documents(spark, awkward_texts() + with_licenses(), extra=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
    got = L.op11_license_scan(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert (r.score > 0) == (r.labels != "")


def test_registered_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = L.op11_license_scan(spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r.doc_id, *brute_base(r.text)) for r in docs)
    assert any("apache-2.0" in r.labels for r in got)


def test_general_form_keeps_spans(spark):
    df = spark.createDataFrame([("k", "Licensed under the Apache License, Version 2.0"), ("l", None)], "key string, body string")
    got = {r.key: r for r in L.scan(df, "key", "body").collect()}
    assert got["l"].detections == [] and got["l"].n_words == 0
    kept = [(d.label, d.start, d.length) for d in got["k"].detections if d.kept]
    assert ("apache-2.0", 0, 8) in kept and all(d.priority == BASE and d.start == 3 for d in got["k"].detections if d.rule == "base:apache")


def test_empty(spark):
    assert L.scan(empty(spark)).collect() == []
