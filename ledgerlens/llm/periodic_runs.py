"""Periodic runs (operator 12): block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and length of
at least max(``least``, 2 q) that no neighbouring word extends. Words are
numbered, and the texts of a batch lie behind one another with a number of its
own after each, so that no run leaves its text. At scale B, for the periods
from 2 B to 4 B (1 to 8 at the first scale):

1. Every stretch on which words q apart agree holds a whole block of B words
   (blocks lie at multiples of B), and the block occurs again q words later.
2. An exact integer NTT correlates each block with the window of words that
   follows at those distances; the sum of squared differences is zero where the
   block occurs. As many primes are taken as the largest possible sum needs.
3. Blocks side by side with the same distance form a chain; the words beyond
   its ends, fewer than B on each side, are compared one by one.

Two things are left out because they can't change the result: a block of which
a word doesn't occur in the window at all has no zero; and inside a known run
of period q <= B a block occurs at the multiples of q only. A stretch of equal
ends is reported once, with its smallest period; every run is found.

A text is handled in one Arrow batch with memory linear in its length, up to
2**25 words. Nothing is shuffled. Edge cases: a null or empty text has no
words, no runs and an empty collapsed text. Repeated rows and null ids give a
row each. Other columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, one_array, regrouped, table, words

#: (prime, primitive root); 2**25 divides each prime - 1 at least.
PRIMES = [(2013265921, 31), (469762049, 3), (167772161, 3)]
FIRST = 2
CELLS = 1 << 18  # of a transform at a time
BATCH_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=64)
def _roots(p: int, g: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the roots of unity of every stage of a transform of length n,
    and of their inverses."""
    out = []
    for base in (pow(g, (p - 1) // n, p), pow(g, (p - 1) - (p - 1) // n, p)):
        powers = np.ones(1, np.uint64)
        while len(powers) < n // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), p)) % np.uint64(p)])
        out.append([powers[::n // 2 // h] for h in (1 << k for k in range(n.bit_length() - 1))])
    return out[0], out[1]


def _forward(a: np.ndarray, p: int, stages: list[np.ndarray]) -> None:
    """The rows' transforms in place, in bit-reversed order."""
    q, (m, _) = np.uint64(p), a.shape
    for w in reversed(stages):
        x = a.reshape(m, -1, 2, len(w))
        u, v = x[:, :, 0].copy(), x[:, :, 1]
        low = u + v
        x[:, :, 0] = np.minimum(low, low - q)
        x[:, :, 1] = (u + q - v) * w % q


def _backward(a: np.ndarray, p: int, stages: list[np.ndarray]) -> None:
    """Undoes ``_forward`` but for a factor of the length."""
    q, (m, _) = np.uint64(p), a.shape
    for w in stages:
        x = a.reshape(m, -1, 2, len(w))
        u, v = x[:, :, 0].copy(), x[:, :, 1] * w % q
        low, high = u + v, u + q - v
        x[:, :, 0] = np.minimum(low, low - q)
        x[:, :, 1] = np.minimum(high, high - q)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, largest: int) -> np.ndarray:
    """(row, shift) booleans: where the row's block of B numbers (0 to
    ``largest``) equals the window's numbers from that shift on. A window holds
    at most 3 B numbers; the sum of squared differences is exact."""
    m, b = blocks.shape
    n, shifts = 4 * b, windows.shape[1] - b + 1
    zero = np.ones((m, shifts), bool)
    room, need = 1, largest * largest * b
    for p, g in PRIMES:
        if room > need:
            break
        room *= p
        q = np.uint64(p)
        forward, backward = _roots(p, g, n)
        x, y = np.zeros((m, n), np.uint64), np.zeros((m, n), np.uint64)
        x[:, :b] = blocks[:, ::-1]
        y[:, :windows.shape[1]] = windows
        squares = np.cumsum(np.pad(y * y % q, ((0, 0), (1, 0))), axis=1)
        total = (x * x % q).sum(axis=1, keepdims=True) + squares[:, b:b + shifts] - squares[:, :shifts]
        _forward(x, p, forward)
        _forward(y, p, forward)
        x = x * y % q
        _backward(x, p, backward)
        products = x[:, b - 1:b - 1 + shifts] * np.uint64(pow(n, p - 2, p)) % q
        zero &= total % q == products * np.uint64(2) % q
    if room <= need:
        raise ValueError("text too long")
    return zero


class _Places:
    """Where each number occurs, for questions about distances."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.keys = np.sort(x * (self.n + 1) + np.arange(self.n))

    def again(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the number at each place occurs ``low`` to ``high - 1`` later."""
        here = self.x[at] * (self.n + 1) + at
        i = np.searchsorted(self.keys, here + low)
        # keys from (number + 1) * (n + 1) on are of the next number
        end = np.minimum(here + high, (self.x[at] + 1) * (self.n + 1))
        return (i < self.n) & (self.keys[np.minimum(i, self.n - 1)] < end)


def _equal_words(x: np.ndarray, start: np.ndarray, d: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words, up to ``most``, from ``start`` on in direction ``step``
    equal those ``d`` later."""
    n, out = len(x), np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    width = 4
    done = 0
    while done < most and len(left):
        width = min(width, most - done)
        i = start[left, None] + step * (done + np.arange(width))
        j = i + d[left, None]
        same = (i >= 0) & (j < n)
        same &= x[np.clip(i, 0, n - 1)] == x[np.minimum(j, n - 1)]
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[left] += run
        left = left[run == width]
        done += width
        width = min(2 * width, max(4, CELLS // max(1, len(left))))
    return out


def runs(x: np.ndarray, least: int = 12, longest: int | None = None) -> np.ndarray:
    """All runs of the numbers ``x`` (0 or more) as rows (start, end, period),
    sorted by start and period. ``longest`` bounds the length of a run."""
    if least < 5:
        raise ValueError("least is 5 words or more: a shorter stretch may hold no block")
    n, longest = len(x), len(x) if longest is None else longest
    x = x.astype(np.int64)
    found = np.zeros((0, 3), np.int64)
    if n < 2:
        return found
    places, largest = _Places(x), int(x.max()) + 1
    b = FIRST
    while (1 if b == FIRST else 2 * b) * 2 <= longest:
        low, high = (1 if b == FIRST else 2 * b), 4 * b
        at = np.arange(n // b, dtype=np.int64) * b
        if len(found):  # inside a run of a period up to b, and the window as well
            inner = found[found[:, 2] <= b]
            first, last = -(-inner[:, 0] // b), (inner[:, 1] - high - b) // b
            deep = np.zeros(len(at) + 1, np.int64)
            ok = last >= first
            np.add.at(deep, first[ok], 1)
            np.add.at(deep, last[ok] + 1, -1)
            at = at[np.cumsum(deep[:-1]) == 0]
        done = 0
        while done < b and len(at):  # each word of a block has to occur in the window
            width = max(1, done)
            for a in range(0, len(at), max(1, CELLS // width)):
                part = at[a:a + max(1, CELLS // width)]
                ok = places.again((part[:, None] + np.arange(done, done + width)).ravel(), low, high).reshape(len(part), width).all(axis=1)
                at[a:a + len(part)] = np.where(ok, part, -1)
            at = at[at >= 0]
            done += width
        seeds = []
        span = high - low + b - 1
        for a in range(0, len(at), max(1, CELLS // (4 * b))):
            part = at[a:a + max(1, CELLS // (4 * b))]
            i = part[:, None] + low + np.arange(span)
            windows = np.where(i < n, x[np.minimum(i, n - 1)], largest)
            row, shift = np.nonzero(zero_mismatches(x[part[:, None] + np.arange(b)], windows, largest))
            seeds.append(np.stack([shift + low, part[row]]))
        d, pos = np.concatenate(seeds, axis=1) if seeds else np.zeros((2, 0), np.int64)
        if len(d):
            if len(found):  # a multiple of the period of a run around it
                by_start = found[np.argsort(found[:, 0], kind="stable")]
                reach = np.maximum.accumulate(by_start[:, 1])
                best = np.maximum.accumulate(np.where(by_start[:, 1] == reach, np.arange(len(by_start)), 0))
                k = np.searchsorted(by_start[:, 0], pos, side="right") - 1
                around = by_start[best[np.maximum(k, 0)]]
                fresh = ~((k >= 0) & (pos + b + d <= around[:, 1]) & (d % around[:, 2] == 0))
                d, pos = d[fresh], pos[fresh]
            order = np.lexsort((pos, d))
            d, pos = d[order], pos[order]
            new = np.ones(len(d) + 1, bool)
            new[1:-1] = (d[1:] != d[:-1]) | (pos[1:] != pos[:-1] + b)
            first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
            d, start, end = d[first], pos[first], pos[last] + b
            wide = end - start + 2 * b > d  # else too short even with its ends
            d, start, end = d[wide], start[wide], end[wide]
            before, after = _equal_words(x, start - 1, d, -1, b), _equal_words(x, end, d, 1, b)
            start, end = start - before, end + after
            # a whole block more was left out above: the stretch is of a known run
            ok = (before < b) & (after < b) & (end - start >= d) & (end - start + d >= least)
            found = np.concatenate([found, np.stack([start, end + d, d], axis=1)[ok]])
        b *= 2
    if len(found):
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, their lengths, words of each text)."""
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offs[:-1][offs[1:] > offs[:-1]]
    first[starts] = inside[starts]
    n = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    lens = np.bincount(n[1:][inside] - 1, minlength=n[-1]).astype(np.int64)
    return buf[inside], lens, np.diff(n[offs])


def _collapsed(letters: np.ndarray, lens: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    where = np.flatnonzero(kept)
    spaced = np.append(False, text_of[where[1:]] == text_of[where[:-1]])[:len(where)]
    size = lens[where] + spaced
    ends = np.cumsum(size)
    out = np.full(int(size.sum()), 32, np.uint8)
    mine = np.ones(len(out), bool)
    mine[(ends - size)[spaced]] = False
    out[mine] = letters[np.repeat(kept, lens)]
    offs = np.concatenate([[0], np.cumsum(np.bincount(text_of[where], size, len(counts)).astype(np.int64))])
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)])


def _find(least: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in regrouped(batches, "_text", BATCH_BYTES):
            letters, lens, counts = _words(*byte_view(one_array(t["_text"])))
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            each = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
            text_of = np.repeat(np.arange(len(counts)), counts)
            # a number of its own after each text
            x = np.zeros(len(lens) + len(counts), np.int64)
            at = np.arange(len(lens)) + text_of
            x[at] = each.indices.to_numpy()
            x[np.cumsum(counts + 1) - 1] = len(each.dictionary) + np.arange(len(counts))
            got = runs(x, least, int(counts.max(initial=0)))
            begin = np.cumsum(counts + 1) - counts - 1
            mine = np.searchsorted(begin, got[:, 0], side="right") - 1
            cover = np.zeros(len(x) + 1, np.int64)
            np.add.at(cover, got[:, 0] + got[:, 2], 1)
            np.add.at(cover, got[:, 1], -1)
            kept = np.cumsum(cover[:-1])[at] == 0
            values = pa.StructArray.from_arrays([pa.array(got[:, 0] - begin[mine]), pa.array(got[:, 1] - got[:, 0]), pa.array(got[:, 2])], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=len(counts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), values).cast(schema.field(2).type)
            yield from pa.Table.from_arrays([one_array(t["_id"]), pa.array(counts), lists, _collapsed(letters, lens, counts, kept)], schema=schema).to_batches()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per document: id, n_words, ``runs`` (an array of start, length
    and period in words, by start and period) and ``collapsed``, the text
    without the words that a run repeats after its first period."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType
    out = f"_id {kind.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    from pyspark.sql.pandas.types import to_arrow_type

    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", pa.list_(item)), ("collapsed", pa.large_string())])
    return rows.mapInArrow(_find(least, schema), out).withColumnRenamed("_id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """The contract's input: (doc_id, text), where the texts of a tenth of the
    ids, by crc32, repeat a stretch of their words from some word to the end."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))
    n, g = F.size("_w").cast("long"), F.floor(F.col("_h") / 10)
    rows = rows.withColumns({"_n": n, "_a": F.when(n > 0, g % n), "_g": g})
    rest = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    cycle = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest.cast("int"))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    got = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    got = got.withColumn("_best", best)
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), F.col("_best.length").alias("length"),
                      (-F.col("_best.p")).alias("period"), F.floor(1000 * F.col("_best.length") / -F.col("_best.p")).alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
