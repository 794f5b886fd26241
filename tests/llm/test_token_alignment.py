import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import token_alignment as A

from .helpers import awkward_texts, documents, empty

SF = "/root/testdata/sf0.001"
JSON = open(public_tokenizers.path("byte_bpe_50k.json")).read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def byte_decoder():
    """Byte-level characters, from the tokenizer's own table of single bytes."""
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Brute:
    """Whole texts, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_str(JSON)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
        self.table = byte_decoder()

    def groups(self, text):
        if not text:
            return None
        raw = (" " + text).encode()
        a = [(i, bytes(self.table[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return None

        def ends(tokens):
            at, out = 0, []
            for _, x in tokens:
                at += len(x)
                out.append(at)
            return out

        cuts = sorted(set(ends(a)) & set(ends(b)))
        found = [([], []) for _ in cuts]
        for side, tokens in ((0, a), (1, b)):
            k = 0
            for (i, _), e in zip(tokens, ends(tokens)):
                while cuts[k] < e:
                    k += 1
                found[k][side].append(i)
        return found


def brute(rows):
    br = Brute()
    per, count = [], Counter()
    for doc_id, text in rows:
        g = br.groups(text)
        links = Counter((x, y) for a, b in g or [] for x in a for y in b)
        count.update(links.keys())
        per.append((doc_id, g, links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = Counter()
    for doc_id, g, links in per:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out[(doc_id, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(links.values()),
             sum(n for k, n in links.items() if count[k] == most[k[0]]), sum(n * count[k] for k, n in links.items()),
             hashlib.sha256(text.encode()).hexdigest() if g else "")] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.collect())


AWKWARD = ["a▁b", " lead", "  two", "tab\there", "end ", "\n\n x \n", "<|endoftext|> <s> </s> <unk>", "\x00 nul", "日本語 テスト 🙂🙂", "１２３ 456789 3.14159", "é é", "　wide nbsp", "a" * 3000, "ab" * 2000, "9" * 500]


def test_against_brute_force(spark):
    texts = [t if t is None or len(t) < 20_000 else t[:20_000] for t in awkward_texts()] + AWKWARD
    df = documents(spark, texts, extra=True)
    assert got(A.align(df, JSON, MODEL)[0]) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_registered_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(A.op13_token_alignment(spark, SF)) == brute(rows)


def test_small_blocks_parts_and_groups(spark, monkeypatch):
    """Blocks of a few texts, texts in several parts, every group through its distinct ids."""
    texts = awkward_texts()[:16] + AWKWARD
    texts = [t if t is None or len(t) < 9_000 else t[:9_000] for t in texts]
    df = documents(spark, texts).repartition(2)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    monkeypatch.setattr(A, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(A, "PART_BYTES", 500)
    monkeypatch.setattr(A, "FEW_LINKS", 0)
    monkeypatch.setattr(A, "TOGETHER", 3)
    monkeypatch.setattr(A, "KNOWN_BYTES", 20_000)
    docs, pairs = A.align(df, JSON, MODEL)
    assert got(docs) == want
    top = pairs.where("top").count()
    assert 0 < top <= pairs.count() and pairs.groupBy("a", "b").count().where("count > 1").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_terminals_against_common_ends(seed):
    rnd = random.Random(seed)
    for _ in range(50):
        n = rnd.randint(1, 60)
        a, b = ([*sorted(rnd.sample(range(1, n), rnd.randint(0, n - 1))), n] for _ in range(2))
        common = sorted(set(a) & set(b))
        ends_b = np.array(b)
        to_a, to_b = A.terminals(np.diff(a, prepend=0), np.diff(b, prepend=0))
        assert ends_b[to_a].tolist() == [next(c for c in common if c >= e) for e in a]
        assert ends_b[to_b].tolist() == [next(c for c in common if c >= e) for e in b]


def test_long_chain_converges():
    """Two sides that meet at the end only."""
    a, b = np.arange(3, 300_000, 2), np.arange(2, 300_000, 2)
    a, b = np.append(a, 300_000), np.append(b, 300_000)
    to_a, to_b = A.terminals(np.diff(a, prepend=0), np.diff(b, prepend=0))
    assert set(to_a) == set(to_b) == {len(b) - 1}


def test_big_groups_go_by_distinct_ids():
    rnd = np.random.default_rng(0)
    ga, gb = np.sort(rnd.integers(0, 5, 400)), np.sort(rnd.integers(0, 5, 300))
    a, b = rnd.integers(0, 9, 400), rnd.integers(0, 9, 300)
    want = Counter((g, x, y) for g, x in zip(ga.tolist(), a.tolist()) for h, y in zip(gb.tolist(), b.tolist()) if g == h)
    out = Counter()
    for g, x, y, w in zip(*(v.tolist() for v in A.linked(ga, a, gb, b, 5))):
        out[(g, x, y)] += w
    assert out == want


def test_general_form_and_empty(spark):
    df = spark.createDataFrame([("k", "two words"), ("k", "two words"), ("l", None)], "key string, body string")
    docs, pairs = A.align(df, JSON, MODEL, "key", "body")
    rows = docs.collect()
    assert docs.columns == ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [(r.key, r.n_groups, r.count_sum) for r in sorted(rows)] == [("k", 2, 2 * r.n_links) if r.key == "k" else ("l", 0, 0) for r in sorted(rows)]
    assert {r.n for r in pairs.collect()} == {2} and A.align(empty(spark), JSON, MODEL)[0].collect() == []
