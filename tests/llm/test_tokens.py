import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import pieces, token_counts, token_files, word_table

from .helpers import awkward_texts, documents, empty

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


TEXTS = st.lists(st.sampled_from([*"aAé '12!\n\t<|>", "\u00a0", "\u2003", "\u0085", "日", "<|endoftext|>", "  ", " \u3000 ", "'s"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    import pyarrow as pa

    enc = test_pieces_give_the_librarys_ids.encoder
    n, ids = enc.documents(pa.array(texts, pa.string()), with_ids=True)
    want = [ids_of_byte(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


test_pieces_give_the_librarys_ids.encoder = pieces.Encoder(open(BYTES, encoding="utf-8").read())
_BYTE = Tokenizer.from_file(BYTES)


def ids_of_byte(text):
    return _BYTE.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    df = documents(spark, extra=True)
    got = token_counts.count_tokens(df, P.path(name), batch_bytes=2000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    if name.endswith("json"):
        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda x: len(m.encode(x or ""))
    want = sorted(str((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 512)) for r in df.collect())
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert token_counts.count_tokens(empty(spark), P.path(name)).collect() == []


def test_word_table(spark):
    df = documents(spark, extra=True)
    t = Tokenizer.from_file(WORDS)
    full = word_table.encode_documents(df, WORDS, block_bytes=3000, n_buckets=5)
    digests = word_table.encode_documents(df, WORDS, digests=True)
    want_full, want = [], []
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want_full.append(str((r.doc_id, ids, text)))
        want.append(str((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in full.collect()) == sorted(want_full)
    assert sorted(str(tuple(r)) for r in digests.collect()) == sorted(want)
    assert word_table.encode_documents(empty(spark), WORDS, digests=True).collect() == []
    assert word_table.encode_documents(documents(spark, [None, "", " "]), WORDS).collect()[0].ids == []


def test_word_table_keeps_words_of_over_65535_ids(spark):
    texts = ["0123456789" * 7000, "after it", "日本語" * 9000, "the words that come later", None, "0123456789" * 7000 + " again"]
    df = documents(spark, texts).coalesce(1)
    t = Tokenizer.from_file(WORDS)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert max(map(len, want)) > 1 << 16
    full = {r.doc_id: r.ids for r in word_table.encode_documents(df, WORDS, n_buckets=2).collect()}
    assert [full[k] for k in range(len(texts))] == want
    digests = {r.doc_id: r for r in word_table.encode_documents(df, WORDS, digests=True, n_buckets=2).collect()}
    for k, ids in enumerate(want):
        assert digests[k].n_tokens == len(ids)
        assert digests[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_table_reads_a_bucket_as_a_stream(spark):
    t = Tokenizer.from_file(WORDS)
    shared = spark.sparkContext.broadcast(t.to_str())
    lists = [[f"word{j}" for j in range(i, i + 300)] + ["日本語", "x" * (i + 1)] for i in range(40)]
    blocks = spark.createDataFrame([(i, [bytearray(word_table._pack("\n".join(w).encode()))]) for i, w in enumerate(lists)], "block long, words array<binary>")
    for run_bytes, table_bytes in ((1, 1 << 20), (5000, 8000), (1 << 20, 1 << 20)):
        got = word_table.encode_words(blocks, shared, run_bytes, table_bytes).orderBy("block").collect()
        assert [r.block for r in got] == list(range(40)) and {r.bucket for r in got} == {0}
        for r, words in zip(got, lists):
            want = [t.encode(w, add_special_tokens=False).ids for w in words]
            assert word_table._unpack_codes(r.lens).tolist() == [len(w) for w in want]
            assert word_table._unpack_codes(r.ids).tolist() == [i for w in want for i in w]
    runs = [len(x) for _, x in word_table._runs([word_table.pa.RecordBatch.from_pylist([{"words": bytes(word_table._pack("\n".join(w).encode()))} for w in lists])], 8000)]
    assert sum(runs) == 40 and max(runs) <= 8000 // 2000


def test_word_table_refuses_other_tokenizers(spark):
    with pytest.raises(ValueError):
        word_table.encode_documents(documents(spark), BYTES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=900))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(gaps)
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    assert code.all().tolist() == values.tolist()
    for i in {0, len(gaps) // 2, len(gaps) - 1}:
        assert code.select(i) == values[i]
    assert len(code.low) + len(code.high) <= len(gaps) * (3 + np.log2(max(2, values[-1] / len(gaps)))) / 8 + 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=1500), st.data())
def test_select_of_given_places(gaps, data):
    values = np.cumsum(gaps)
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    places = data.draw(st.lists(st.integers(0, len(gaps) - 1), max_size=20))
    assert code.select_many(np.array(places, np.int64)).tolist() == values[places].tolist() if places else len(code.select_many(np.array([]))) == 0
    assert code.select_many(np.arange(code.n)).tolist() == values.tolist()


def test_documents_of_given_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    texts = [*awkward_texts(), *(f"text {i} " * (i % 7) for i in range(700))]
    token_files.write_token_files(documents(spark, texts).repartition(3), BYTES, path, segment_bytes=4000)
    numbers = [0, 1, 255, 256, len(texts) - 1, len(texts), 15, 15]
    got = token_files.read_documents(spark, path, numbers).collect()
    assert sorted((r.number, r.doc_id, tuple(r.ids)) for r in got) == [(k, k, (*ids_of_byte(texts[k]), 0)) for k in sorted({*numbers} - {len(texts)})]
    assert token_files.read_documents(spark, path, []).collect() == []


def test_token_files(spark, tmp_path):
    df = documents(spark, extra=True).repartition(4)
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(df, BYTES, path, segment_bytes=4000)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).collect()]
    rows = df.select("doc_id", "text").collect()
    assert sorted(map(str, (r[0] for r in got))) == sorted(str(r.doc_id) for r in rows)
    start = 0
    want = {}
    for r in rows:
        ids = np.array(ids_of_byte(r.text) + [0], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc_id, s, n, crc in sorted(got, key=lambda x: x[1]):
        assert s == start and (n, crc) in want[doc_id]
        start += n
    order = [x[0] for x in sorted(got, key=lambda x: x[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    none = f"file://{tmp_path}/none"
    token_files.write_token_files(empty(spark), BYTES, none)
    assert token_files.read_token_files(spark, none).collect() == []


def test_every_awkward_text_splits_safely():
    import pyarrow as pa

    enc = test_pieces_give_the_librarys_ids.encoder
    n, ids = enc.documents(pa.array(awkward_texts(), pa.string()), with_ids=True)
    assert ids.tolist() == [i for t in awkward_texts() for i in ids_of_byte(t)]


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    """Unspaced texts, each a piece of its own: a worker keeps no more than the stated bytes."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from ledgerlens.llm import pieces
    monkeypatch.setattr(pieces, "KNOWN_BYTES", 400_000)
    enc = pieces.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    rnd = np.random.default_rng(0)
    for _ in range(40):
        texts = ["".join(map(chr, rnd.integers(0x4E00, 0x9FA5, 3_000))) for _ in range(3)] + ["plain words here"]
        lens, ids = enc.documents(pa.array(texts), with_ids=True)
        assert lens.tolist() == [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts] and len(ids) == lens.sum()
        assert enc.known.nbytes + enc.ids.nbytes + enc.starts.nbytes + enc.lens.nbytes <= 400_000
    assert len(enc.known)
