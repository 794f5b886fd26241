"""Byte-level BPE in batches: texts are cut at safe boundaries and each
distinct piece of a batch is encoded once, by the ``tokenizers`` library.

A cut before a single space between two other characters, neither of them
white space, is safe: the byte-level pre-tokenizer always starts a new word
there, no special token holds a space, and no look-ahead crosses it. Any
doubt about a neighbour (a byte that may belong to a Unicode space) means no
cut, which costs time but changes nothing."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_view, worker_state

#: First bytes of characters among which Unicode has white space, and control bytes.
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[:33] = True
MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LEAD_3 = np.zeros(256, bool)
LEAD_3[[0xE1, 0xE2, 0xE3]] = True
STEP = 4 << 20
GROUP = 16 << 20
#: Bytes of pieces and of their ids that a worker remembers between batches, whatever the length of a
#: piece. Only speed depends on it.
KNOWN_BYTES = 48 << 20


def safe_cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted positions: every text boundary and every safe cut inside."""
    found = []
    n = len(buf)
    for a in range(0, n, STEP):
        i = np.flatnonzero(buf[a:a + STEP] == 32) + a
        i = i[(i > 0) & (i < n - 1)]
        ok = (buf[i - 1] > 32) & ~MAY_BE_SPACE[buf[i + 1]] & (buf[np.maximum(i - 2, 0)] != 0xC2) & ~LEAD_3[buf[np.maximum(i - 3, 0)]]
        found.append(i[ok])
    inner = np.concatenate(found) if found else np.zeros(0, np.int64)
    cuts = np.sort(np.concatenate([inner, offs]), kind="stable")
    return cuts[np.append(True, cuts[1:] != cuts[:-1])] if len(cuts) else cuts


def splits_safely(tokenizer_json: str) -> bool:
    """Whether ``safe_cuts`` holds for this tokenizer: byte-level, the usual
    word pattern, nothing added or normalised, no special token with a space."""
    t = json.loads(tokenizer_json)
    pre = t.get("pre_tokenizer") or {}
    return (t.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and all(" " not in x["content"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in t.get("added_tokens") or []))


class Encoder:
    """A tokenizer in a Python worker, with the pieces it has met."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.safe = splits_safely(tokenizer_json)
        n = self.tok.get_vocab_size()
        special = {int(k): v.content for k, v in self.tok.get_added_tokens_decoder().items()}
        # a byte-level token has one character for each byte
        self.n_bytes = np.array([len(special[i].encode()) if i in special else len(self.tok.id_to_token(i) or "") for i in range(n)], np.int64)
        self.known = pa.array([], pa.binary())
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, all ids in order)."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return lens, np.fromiter((i for g in got for i in g), np.uint32, int(lens.sum()))

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``texts``, for pieces that begin with a space: one text of many
        pieces is encoded at once, and the tokens' byte lengths tell them apart."""
        buf, offs = byte_view(pieces)
        lens, ids = [], []
        step = 4096
        for a in range(0, len(pieces), step):
            part = offs[a:a + step + 1]
            raw = buf[part[0]:part[-1]].tobytes().decode()
            got = np.array(self.tok.encode_batch_fast([raw], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.n_bytes[got])
            at = np.searchsorted(ends, part[1:] - part[0])
            if at[-1] >= len(ends) or (ends[at] != part[1:] - part[0]).any():  # not expected; then one by one
                n, got = self.texts([x.decode() for x in pieces.slice(a, len(part) - 1).to_pylist()])
            else:
                n = np.diff(np.concatenate([[-1], at]))
            lens.append(n)
            ids.append(got)
        return np.concatenate(lens) if lens else np.zeros(0, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids) of distinct pieces; ids[start:start + length] are a piece's."""
        at = pc.index_in(pieces, value_set=self.known) if len(self.known) else pa.nulls(len(pieces), pa.int32())
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        base = len(self.ids)
        starts, lens, ids = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), self.ids
        if len(new) < len(pieces):
            old = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            where = at.drop_null().to_numpy()
            starts[old], lens[old] = self.starts[where], self.lens[where]
        if len(new):
            fresh = pieces.take(pa.array(new))
            spaced = pc.starts_with(fresh, b" ").to_numpy(zero_copy_only=False)
            n = np.zeros(len(fresh), np.int64)
            a, b = np.flatnonzero(spaced), np.flatnonzero(~spaced)
            n[a], ids_a = self._joined(fresh.take(pa.array(a)))
            n[b], ids_b = self.texts([x.decode() for x in fresh.take(pa.array(b)).to_pylist()])
            s = np.zeros(len(fresh), np.int64)
            s[a] = base + np.cumsum(n[a]) - n[a]
            s[b] = base + len(ids_a) + np.cumsum(n[b]) - n[b]
            starts[new], lens[new] = s, n
            ids = np.concatenate([self.ids, ids_a, ids_b])
            if self.known.nbytes + fresh.nbytes + 16 * (len(self.known) + len(fresh)) + ids.nbytes <= KNOWN_BYTES:
                self.known = pa.concat_arrays([self.known, fresh])
                self.starts, self.lens, self.ids = np.concatenate([self.starts, s]), np.concatenate([self.lens, n]), ids
        return starts, lens, ids

    def documents(self, column: pa.Array, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each text, ids of all texts in order or None)."""
        buf, offs = byte_view(column)
        if not self.safe:
            lens, ids = [], []
            for a in range(0, len(column), 256):
                n, got = self.texts([x or "" for x in column.slice(a, 256).to_pylist()])
                lens.append(n)
                ids.append(got)
            return np.concatenate(lens or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.uint32)])
        cuts = safe_cuts(buf, offs)
        counts, all_ids = [], []
        a = 0
        while a < len(cuts) - 1:  # long texts go in groups of pieces
            b = int(np.searchsorted(cuts, cuts[a] + GROUP, side="right")) - 1
            b = min(max(b, a + 1), len(cuts) - 1)
            part = cuts[a:b + 1]
            raw = pa.py_buffer(np.ascontiguousarray(buf[part[0]:part[-1]]))
            rel = (part - part[0]).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(rel) - 1, [None, pa.py_buffer(rel), raw]).cast(pa.binary()) if rel[-1] < 1 << 31 else None
            if pieces is None:  # one piece of over 2 GB
                n, got = self.texts([bytes(buf[part[0]:part[-1]]).decode()])
            else:
                coded = pieces.dictionary_encode()
                starts, lens, ids = self.distinct(coded.dictionary)
                code = coded.indices.to_numpy()
                n = lens[code]
                if with_ids:
                    total = int(n.sum())
                    got = ids[np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(total)]
            counts.append(n)
            if with_ids:
                all_ids.append(got)
            a = b
        sums = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        at = np.searchsorted(cuts, offs)
        return np.diff(sums[at]), (np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)) if with_ids else None


def encoder(tokenizer_json: str) -> Encoder:
    return worker_state(f"encoder_{hash(tokenizer_json)}", lambda: Encoder(tokenizer_json))
