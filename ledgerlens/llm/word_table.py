"""BPE encoding and decoding (operator 8) through a distinct-word table.

1. Texts are split at ASCII white space, which the tokenizer drops, in blocks
   of about 16 MB. A block keeps its distinct words and, for every document,
   the positions: each word as its number among the block's words.
2. The blocks' words meet by hash of the word; each distinct word is encoded
   once, by the ``tokenizers`` library. That is the word table. A bucket is a
   stream of lists, so what its task holds doesn't grow with the blocks; a
   bucket of over ``TABLE_BYTES`` of distinct words encodes some again.
3. The ids go back to the blocks and are joined by position. Decoding joins
   ids to the vocabulary's pieces.

A word takes part once a block, so the most frequent words are no hot keys;
blocks' lists are packed before the shuffles. The split blocks are a written
table, from which lost tasks are done again; it is bucketed by block, so that
only the ids move when they are joined to it.

This holds for tokenizers that encode text split at ASCII white space as the
parts one after another; ``check_tokenizer`` refuses others.

Edge cases: a null text is empty; an empty text has no ids and decodes to the
empty string. Strings of special tokens inside texts get the library's
default. Repeated rows and ids give repeated results. An empty table gives an
empty result. Other columns are ignored."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, materialize_by, one_array, regrouped, table, worker_state

BLOCK_BYTES = 16 << 20
RUN_BYTES = 32 << 20
TABLE_BYTES = 128 << 20
ENCODE_BYTES = 1 << 20


def check_tokenizer(tokenizer_json: str) -> None:
    """Raise unless white space is dropped and separates words."""
    t = json.loads(tokenizer_json)
    pre = t.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern"))
    if not drops or t.get("decoder") is not None or any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in t.get("added_tokens") or []):
        raise ValueError("this tokenizer doesn't encode words apart from each other")


def _pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes() if isinstance(a, np.ndarray) else a)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _pack_codes(codes: np.ndarray) -> bytes:
    """Numbers below 2**32, planes of bytes apart: the high planes compress well."""
    wide = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _pack(np.ascontiguousarray(wide.T))


def _unpack_codes(raw: bytes) -> np.ndarray:
    planes = _unpack(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _word_hash(words: pa.Array, n_buckets: int) -> np.ndarray:
    """A bucket of each word, from its bytes alone."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return (h % np.uint64(n_buckets)).astype(np.int32)


def split_blocks(rows: DataFrame, n_buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its documents, their words as numbers, and the distinct
    words of each bucket, in the order of their numbers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(regrouped(batches, "text", block_bytes)):
            text = one_array(rows["text"])
            split = pc.ascii_split_whitespace(text)
            flat, offs = split.flatten(), split.offsets.to_numpy()
            some = pc.not_equal(pc.binary_length(flat), 0)
            if not pc.all(some, min_count=0).as_py():  # white space at the ends leaves empty words
                before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
                offs, flat = before[offs - offs[0]], flat.filter(some)
            coded = flat.dictionary_encode()
            d = coded.dictionary
            if not len(d):
                d = pa.array([], pa.string())
            bucket = _word_hash(d.cast(pa.binary()), n_buckets)
            # numbers by bucket, and by frequency in each bucket: small numbers are frequent
            code = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
            count = np.bincount(code, minlength=len(d))
            order = np.lexsort((-count, bucket))
            number = np.empty(len(d), np.int64)
            number[order] = np.arange(len(d))
            by_frequency = np.argsort(-count, kind="stable")
            rank = np.empty(len(d), np.int64)
            rank[by_frequency] = np.arange(len(d))
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            sorted_words = d.take(pa.array(order))
            lists = []
            for b in range(n_buckets):
                w = sorted_words.slice(edges[b], edges[b + 1] - edges[b])
                lists.append(_pack("\n".join(w.to_pylist()).encode()) if len(w) else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k], pa.int64()), pa.array([one_array(rows["doc_id"])], pa.list_(rows.schema.field("doc_id").type)),
                 pa.array([np.diff(offs).astype(np.int32)], pa.list_(pa.int32())), pa.array([_pack_codes(rank[code])], pa.binary()),
                 pa.array([_pack_codes(rank[order])], pa.binary()), pa.array([lists], pa.list_(pa.binary()))],
                ["block", "doc_ids", "n_words", "codes", "ranks", "words"])

    schema = f"block long, doc_ids array<{kind}>, n_words array<int>, codes binary, ranks binary, words array<binary>"
    return materialize_by(rows.mapInArrow(blocks, schema), "word_blocks", "block")


def _runs(batches, most_bytes: int):
    """(rows, word lists) of a bucket: lists of about ``most_bytes`` at once, one at least."""
    for batch in batches:
        lists, start, held = [], 0, 0
        for k in range(batch.num_rows):
            raw = _unpack(batch.column("words")[k].as_py(), np.uint8).tobytes()
            if lists and held + len(raw) > most_bytes:
                yield batch.slice(start, k - start), lists
                lists, start, held = [], k, 0
            lists.append(pa.array(raw.decode().split("\n"), pa.string()))
            held += len(raw)
        if lists:
            yield batch.slice(start), lists


def _encode(tok, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids, ids) of the words, ``ENCODE_BYTES`` of them at a time."""
    ends = byte_view(words)[1][1:]
    lens, ids, a = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENCODE_BYTES, side="right")))
        got = [e.ids for e in tok.encode_batch_fast(words.slice(a, b - a).to_pylist(), add_special_tokens=False)]
        lens.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter((i for g in got for i in g), np.uint32, int(lens[-1].sum())))
        a = b
    return np.concatenate(lens), np.concatenate(ids)


def encode_words(blocks: DataFrame, shared, run_bytes: int = RUN_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The word table, as each block needs it: (block, bucket, lens, ids), the
    ids of the block's words of that bucket in their order.

    A bucket's lists are read as a stream. Its words are kept up to
    ``table_bytes``; past that the table starts anew, and a word that comes
    again is encoded again."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        known, lens, ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for rows, lists in _runs(batches, run_bytes):
            coded = pa.concat_arrays(lists).dictionary_encode()
            words = coded.dictionary
            if known.nbytes + words.nbytes > table_bytes:
                known, lens, ids = known.slice(0, 0), lens[:0], ids[:0]
            new = words.filter(pc.is_null(pc.index_in(words, value_set=known)))
            new_lens, new_ids = _encode(tok, new)
            known, lens, ids = pa.concat_arrays([known, new]), np.concatenate([lens, new_lens]), np.concatenate([ids, new_ids])
            starts = np.cumsum(lens) - lens
            code = pc.index_in(words, value_set=known).to_numpy()[coded.indices.to_numpy()]
            n, out_ids, a = lens[code], [], 0
            for x in lists:
                c = code[a:a + len(x)]
                m = n[a:a + len(x)]
                out_ids.append(_pack_codes(ids[np.repeat(starts[c] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]))
                a += len(x)
            edges = np.cumsum([0] + [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("bucket"), pa.array([_pack_codes(n[s:e]) for s, e in zip(edges, edges[1:])], pa.binary()),
                                              pa.array(out_ids, pa.binary())], ["block", "bucket", "lens", "ids"])

    need = blocks.select("block", F.posexplode("words").alias("bucket", "words")).where(F.length("words") > 0)
    return need.groupBy("bucket").applyInArrow(encoded, "block long, bucket int, lens binary, ids binary")


def _tokenizer(tokenizer_json: str):
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        tok.no_truncation()
        tok.no_padding()
        return tok

    return worker_state(f"word_tokenizer_{hash(tokenizer_json)}", make)


def _texts(table: pa.Array, ids: np.ndarray, lens: np.ndarray) -> pa.Array:
    """For each word the texts of its ids in ``table``, one after another."""
    flat = table.take(pa.array(ids.astype(np.int64))) if len(ids) else pa.array([], pa.large_binary())
    buf, offs = byte_view(flat)
    at = np.concatenate([[0], np.cumsum(lens)])
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.ascontiguousarray(offs[at])), pa.py_buffer(np.ascontiguousarray(buf))])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
                     block_bytes: int = BLOCK_BYTES, n_buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array) and decoded (text); with
    ``digests`` doc_id, n_tokens and the SHA-256 of the ids' decimals joined
    by a space and of the decoded text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    check_tokenizer(tokenizer_json)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_buckets = n_buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = split_blocks(rows, n_buckets, block_bytes)
    answers = encode_words(blocks, shared).groupBy("block").agg(F.collect_list(F.struct("bucket", "lens", "ids")).alias("answers"))
    whole = blocks.select("block", "doc_ids", "n_words", "codes", "ranks").join(answers.hint("merge"), "block", "left")

    def joined(batches):
        tok = _tokenizer(shared.value)
        n_vocab = tok.get_vocab_size()
        pieces = worker_state(f"pieces_{hash(shared.value)}", lambda: pa.array([(tok.id_to_token(i) or "").encode() + b" " for i in range(n_vocab)], pa.large_binary()))
        decimals = worker_state(f"decimals_{n_vocab}", lambda: pa.array([b"%d " % i for i in range(n_vocab)], pa.large_binary()))
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, n_words = batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                code, rank = _unpack_codes(batch.column(3)[k].as_py()), _unpack_codes(batch.column(4)[k].as_py())
                got = sorted(batch.column(5)[k].as_py() or [], key=lambda x: x["bucket"])
                lens = np.concatenate([_unpack_codes(x["lens"]) for x in got] or [np.zeros(0, np.uint32)]).astype(np.int64)
                ids = np.concatenate([_unpack_codes(x["ids"]) for x in got] or [np.zeros(0, np.uint32)])
                # from the buckets' order to the numbers that the documents use
                order = np.empty(len(rank), np.int64)
                order[rank] = np.arange(len(rank))
                starts = (np.cumsum(lens) - lens)[order]
                lens = lens[order]
                ids = ids[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
                begin = np.cumsum(lens) - lens
                word_ids, word_pieces = _texts(decimals, ids, lens), _texts(pieces, ids, lens)
                ends = np.cumsum(n_words.astype(np.int64))
                # groups of documents of about a million words: what a block holds at once is bounded
                a = 0
                while a < len(ends):
                    w0 = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, w0 + (1 << 20), side="right")))
                    c = code[w0:int(ends[b - 1])].astype(np.int64)
                    at = np.concatenate([[0], ends[a:b] - w0])
                    per_word = np.concatenate([[0], np.cumsum(lens[c])])
                    n = np.diff(per_word[at])
                    columns = [doc_ids.slice(a, b - a)]
                    if digests:
                        columns.append(pa.array(n, pa.int64()))
                        for texts in (word_ids, word_pieces):
                            buf, offs = byte_view(texts.take(pa.array(c)))
                            data, cut = memoryview(np.ascontiguousarray(buf)), offs[at]
                            columns.append(pa.array([hashlib.sha256(data[s:max(s, e - 1)]).hexdigest() for s, e in zip(cut, cut[1:])], pa.string()))
                        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    else:
                        m = lens[c]
                        flat = ids[np.repeat(begin[c] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                        columns.append(pa.ListArray.from_arrays(pa.array(per_word[at], pa.int32()), pa.array(flat.astype(np.int32))))
                        buf, offs = byte_view(word_pieces.take(pa.array(c)))
                        cut = offs[at]
                        columns.append(pa.array([buf[s:max(s, e - 1)].tobytes().decode() for s, e in zip(cut, cut[1:])], pa.string()))
                        names = ["doc_id", "ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    a = b

    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(joined, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))


def op8_word_table(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
