"""Cross-tokenizer alignment (operator 13): pointer jumping over overlaps.

Two tokenizers, a byte-level BPE (A) and a SentencePiece model (B), cut the
same bytes, a space and the text. Every token points to its farthest-right
overlapping token: the other side's token that holds its last byte, or itself
if it ends last. Doubling the pointers converges to each component's terminal
token, which labels the group; groups are the stretches between byte offsets
at which tokens of both sides end. The tokens of a group are linked, each of A
with each of B.

Texts are cut at safe boundaries (before a single space inside a text, where
both tokenizers start a new token), and each distinct piece of a batch is
encoded once. A block of documents is written as its documents' pairs of ids,
numbered within the block, and a list of the block's distinct pairs with their
numbers of documents. Only those lists are added up over the corpus, and the
counts are joined back to the blocks, so a pair that half of all documents hold
is a row a block. A group of many tokens is linked through its distinct ids.

Memory of a task is bounded by the block, or by one text: a long one is
aligned a part at a time and keeps its distinct pairs. Edge cases: a null or
empty text, and one whose tokens' bytes differ from a space and the text, has
no tokens: zeros and ''. Every row is a document: repeated rows and null ids
count and are returned each. Other columns are ignored. An empty table gives an
empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, materialize, one_array, regrouped, table, worker_state
from .pieces import safe_cuts, splits_safely

BLOCK_BYTES = 8 << 20
PART_BYTES = 2 << 20
#: Pieces that are encoded as one text, and bytes of pieces and their ids that a worker remembers
#: between parts. Only speed depends on them.
TOGETHER = 1024
KNOWN_BYTES = 48 << 20
#: A group of more links goes by distinct ids.
FEW_LINKS = 64


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable
    ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: how it encodes a text of pieces, and its tokens' bytes."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after another."""
        n = self.lens[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(n.sum()))]

    def pieces(self, buf: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each piece, ids, whether a piece's tokens are its bytes).
        The pieces from one of ``groups`` to the next are encoded as one text."""
        n, same, ids = [], [], []
        for a, b in zip(groups, groups[1:]):
            raw, ends = buf[offs[a]:offs[b]], offs[a + 1:b + 1] - offs[a]
            got = np.array(self.encode(raw.tobytes().decode()), np.int64)
            at = np.cumsum(self.lens[got])
            k = np.searchsorted(at, ends)
            if len(at) and at[-1] == len(raw) and (at[k] == ends).all() and (self.joined(got) == raw).all():
                n.append(np.diff(k, prepend=-1))
                same.append(np.ones(b - a, bool))
                ids.append(got)
            else:  # one by one, to tell which piece it is
                for i in range(a, b):
                    raw = buf[offs[i]:offs[i + 1]].tobytes()
                    got = np.array(self.encode(raw.decode()), np.int64)
                    n.append(np.array([len(got)]))
                    same.append(np.array([self.joined(got).tobytes() == raw]))
                    ids.append(got)
        return (*(np.concatenate(x) for x in (n, ids, same)),)


class Tokenizers:
    """Both tokenizers in a Python worker, and the pieces it has met."""

    def __init__(self, json_a: str, model_b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        if not splits_safely(json_a):
            raise ValueError("A has to be a plain byte-level tokenizer")
        a = Tokenizer.from_str(json_a)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        to_byte = byte_of_character()
        special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
        bytes_a = [b"" if i in special else bytes(to_byte.get(c, 0) for c in a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B reaches over a word's start")
        # B adds a space of its own
        self.sides = Side(lambda t: a.encode_batch_fast([t], add_special_tokens=False)[0].ids, bytes_a), Side(lambda t: b.encode(t[1:], num_threads=1), bytes_b)
        self.digits = pa.array([f"{i}{s}" for s in ",|;" for i in range(max(len(bytes_a), len(bytes_b)))])
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.right = np.zeros(0, bool)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.sides]  # tokens of each piece, ids

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each of these distinct pieces among the known ones, and
        whether its tokens are its bytes. Every piece starts with a space."""
        if self.known.nbytes + pieces.nbytes + sum(8 * len(ids) for _, ids in self.held) > KNOWN_BYTES:
            self.forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(at.is_null())
        if len(fresh):
            buf, offs = byte_view(fresh)
            # a text ends where the next piece might not begin a token, and after a number of pieces
            apart = np.flatnonzero(~np.isin(offs, safe_cuts(buf, offs[[0, -1]]), assume_unique=True))
            groups = np.unique(np.concatenate([apart, np.arange(0, len(fresh), TOGETHER), [len(fresh)]]))
            ok = np.ones(len(fresh), bool)
            for i, side in enumerate(self.sides):
                n, ids, same = side.pieces(buf, offs, groups)
                ok &= same
                self.held[i] = tuple(np.concatenate(x) for x in zip(self.held[i], (n, ids)))
            where = at.to_numpy(zero_copy_only=False)
            where = np.where(np.isnan(where), 0, where).astype(np.int64)
            where[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
            self.right = np.concatenate([self.right, ok])
        else:
            where = at.to_numpy().astype(np.int64)
        return where, self.right[where]


def terminals(lens_a: np.ndarray, lens_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token (a place in B) of the component of every token of A
    and of B. Both sides cut the same bytes, in tokens of these lengths."""
    n = len(lens_a)
    ends_a, ends_b = np.cumsum(lens_a), np.cumsum(lens_b)
    # the other side's token that holds a token's last byte
    to_b = np.repeat(np.arange(len(lens_b)), lens_b)[ends_a - 1]
    to_a = np.repeat(np.arange(n), lens_a)[ends_b - 1]
    succ = np.concatenate([n + to_b, np.where(ends_a[to_a] == ends_b, n + np.arange(len(ends_b)), to_a)])
    while True:
        further = succ[succ]
        if (further == succ).all():
            return succ[:n] - n, succ[n:] - n
        succ = further


def linked(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, links) of the tokens that share a group; a pair may
    come several times for a small group."""
    links = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
    many = links > FEW_LINKS

    def side(group, ids):
        weight = np.ones(len(ids), np.int64)
        if many.any():
            big = many[group]
            span = int(ids.max(initial=0)) + 1
            u, c = np.unique(group[big] * span + ids[big], return_counts=True)
            group, ids, weight = np.append(group[~big], u // span), np.append(ids[~big], u % span), np.append(weight[~big], c)
            order = np.argsort(group, kind="stable")
            group, ids, weight = group[order], ids[order], weight[order]
        return group, ids, weight

    (ga, a, wa), (gb, b, wb) = side(group_a, ids_a), side(group_b, ids_b)
    per = np.bincount(gb, minlength=n_groups)
    first = np.cumsum(per) - per
    repeat = per[ga]
    left = np.repeat(np.arange(len(ga)), repeat)
    right = np.repeat(first[ga] - (np.cumsum(repeat) - repeat), repeat) + np.arange(len(left))
    return ga[left], a[left], b[right], wa[left] * wb[right]


class _Block:
    """What the parts of a block's texts add up to."""

    def __init__(self, tok: Tokenizers, n: int):
        self.tok, self.n = tok, n
        self.sums = np.zeros((4, n), np.int64)  # A and B tokens, groups, links
        self.wrong = np.zeros(n, bool)
        self.hashes = {}
        self.triples = []

    def add(self, pieces: pa.Array, text_of: np.ndarray) -> None:
        """Pieces, in order, of the texts with these numbers."""
        tok = self.tok
        coded = pieces.dictionary_encode()
        number, right = tok.look_up(coded.dictionary)
        code = coded.indices.to_numpy()
        ok = right[code]
        self.wrong[text_of[~ok]] = True
        code, text_of = number[code[ok]], text_of[ok]

        def spread(n, ids):
            each = n[code]
            at = np.repeat((np.cumsum(n) - n)[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            return ids[at], np.repeat(text_of, each)

        (a, of_a), (b, of_b) = (spread(*held) for held in tok.held)
        if not len(a):
            return
        last_a, last_b = terminals(tok.sides[0].lens[a], tok.sides[1].lens[b])
        ends = last_b == np.arange(len(b))  # the terminal tokens, one a group
        name = np.cumsum(ends) - 1
        group_a, group_b, of = name[last_a], name[last_b], of_b[ends]
        self._hash(a, group_a, b, group_b, of)
        group, left, right, weight = linked(group_a, a, group_b, b, len(of))
        for i, (texts, amount) in enumerate(((of_a, None), (of_b, None), (of, None), (of[group], weight))):
            self.sums[i] += np.bincount(texts, amount, self.n).astype(np.int64) if amount is not None else np.bincount(texts, minlength=self.n)
        self.triples.append(_summed(of[group], left * len(tok.sides[1].tokens) + right, weight))

    def _hash(self, a, group_a, b, group_b, of) -> None:
        """Goes on with every text's ``a1,a2|b1;...``: ids, each with the mark after it."""
        ids = np.concatenate([a, b])
        side = np.repeat([0, 1], [len(a), len(b)])
        group = np.concatenate([group_a, group_b])
        order = np.argsort(2 * group + side, kind="stable")
        ids, side, group = ids[order], side[order], group[order]
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        raw = self.tok.digits.take(pa.array(ids + mark * (len(self.tok.digits) // 3)))
        data, offs = byte_view(raw)
        text_of = of[group]
        edges = np.flatnonzero(np.append(True, text_of[1:] != text_of[:-1]))
        for first, stop in zip(edges, np.append(edges[1:], len(ids))):
            t = int(text_of[first])
            if t in self.hashes:
                self.hashes[t].update(b";")
            else:
                self.hashes[t] = hashlib.sha256()
            self.hashes[t].update(data[offs[first]:offs[stop] - 1])

    def result(self) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sums, hashes, distinct pairs, documents of each, ends of each
        text's entries, their pairs' numbers, their links)."""
        texts, pair, weight = (np.concatenate(x) for x in zip(*self.triples)) if self.triples else (np.zeros(0, np.int64),) * 3
        right = ~self.wrong[texts]
        texts, pair, weight = _summed(texts[right], pair[right], weight[right])
        self.sums[:, self.wrong] = 0
        pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        hashes = ["" if self.wrong[i] or i not in self.hashes else self.hashes[i].hexdigest() for i in range(self.n)]
        return self.sums, hashes, pairs, docs, np.cumsum(np.bincount(texts, minlength=self.n)), at.astype(np.int32), weight


def _summed(texts: np.ndarray, pair: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each (text, pair), with the sum of its weights."""
    if not len(texts):
        return texts, pair, weight
    span = int(pair.max()) + 1
    key = texts * span + pair
    if (weight == 1).all():
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[new]
    return key // span, key % span, np.add.reduceat(weight, new)


def _align(json_a: str, model_b: bytes, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        tok = worker_state(f"aligners_{hash((json_a, model_b))}", lambda: Tokenizers(json_a, model_b))
        for t in regrouped(batches, "_text", BLOCK_BYTES):
            buf, offs = byte_view(one_array(t["_text"]))  # a space and the text; nothing for an empty one
            cuts = safe_cuts(buf, offs)
            block = _Block(tok, t.num_rows)
            a = 0
            while a < len(cuts) - 1:
                b = int(np.searchsorted(cuts, cuts[a] + PART_BYTES, side="right")) - 1
                b = min(max(b, a + 1), len(cuts) - 1)
                part = cuts[a:b + 1]
                raw = pa.py_buffer(np.ascontiguousarray(buf[part[0]:part[-1]]))
                pieces = pa.Array.from_buffers(pa.large_binary(), len(part) - 1, [None, pa.py_buffer(part - part[0]), raw])
                block.add(pieces, np.searchsorted(offs, part[:-1], side="right") - 1)
                a = b
            sums, hashes, pairs, docs, ends, at, weight = block.result()
            name = uuid.uuid4().hex
            n = t.num_rows
            split = [0, *ends.tolist()]
            rows = [pa.array([name] * n), one_array(t["_id"]), *map(pa.array, sums), pa.array(hashes),
                    pa.array([at[i:j].tobytes() for i, j in zip(split, split[1:])], pa.binary()),
                    pa.array([weight[i:j].tobytes() for i, j in zip(split, split[1:])], pa.binary()), pa.nulls(n, schema.field(9).type), pa.nulls(n, schema.field(10).type)]
            yield from pa.Table.from_arrays(rows, schema=schema).to_batches()
            if len(pairs):
                one = [pa.nulls(1, f.type) for f in schema]
                one[0], one[9], one[10] = pa.array([name]), pa.array([pairs], schema.field(9).type), pa.array([docs], schema.field(10).type)
                yield from pa.Table.from_arrays(one, schema=schema).to_batches()

    return run


def _counted(schema: pa.Schema):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        n, top = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        number = counts["number"].to_numpy()
        n[number], top[number] = counts["n"].to_numpy(), counts["top"].to_numpy()
        best, total = [], []
        for at, links in zip(docs["at"].to_pylist(), docs["links"].to_pylist()):
            at, links = np.frombuffer(at, np.int32), np.frombuffer(links, np.int64)
            best.append(int(links[top[at]].sum()))
            total.append(int((links * n[at]).sum()))
        return pa.Table.from_arrays([*(docs[c] for c in ("_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best, pa.int64()), pa.array(total, pa.int64()), docs["hash"]], schema=schema)

    return run


def align(docs: DataFrame, json_a: str, model_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256. Pairs: a, b, n (documents that hold the pair
    linked) and top (no other pair of the A id has more)."""
    import sentencepiece
    from pyspark.sql.pandas.types import to_arrow_type

    width = sentencepiece.SentencePieceProcessor(model_proto=model_b).get_piece_size()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").alias("_text"))
    kind = rows.schema["_id"].dataType
    out = (f"block string, _id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, hash string, at binary, links binary, "
           "pairs array<bigint>, docs array<bigint>")
    ids, long = to_arrow_type(kind), pa.int64()
    schema = pa.schema([("block", pa.string()), ("_id", ids), *((c, long) for c in ("n_a", "n_b", "n_groups", "n_links")), ("hash", pa.string()),
                        ("at", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(long)), ("docs", pa.list_(long))])
    blocks = materialize(rows.mapInArrow(_align(json_a, model_b, schema), out), "aligned")
    listed = (blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("number", "p"))
              .select("block", "number", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")))
    counts = materialize(listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    pairs = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    back = listed.join(pairs, "pair").select(F.col("block").alias("of_block"), "number", "n", "top")
    got = f"{id_col} {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    result = pa.schema([(id_col, ids), *((c, long) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
    of_docs = blocks.where("pairs is null").drop("pairs", "docs")
    return (of_docs.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_counted(result), got),
            pairs.select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n", "top"))


def op13_token_alignment(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align(table(spark, sf_dir, "documents"), a.read(), b.read())[0]
