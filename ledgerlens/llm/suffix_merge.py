"""Suffix-array dedup (operator 3): shard Burrows-Wheeler transforms, merged by
iterative interleave refinement.

Every byte that is covered by a ``width``-byte string which also starts
anywhere else is removed. The steps:

1. Anchors. Each window of ``width`` bytes chooses the 64-byte string of least
   hash in it. Equal windows choose equal strings at equal places, so windows
   need to meet only if their anchors are equal. Anchors are counted; a
   Bloom filter of those that occur again (of bounded size) goes to all tasks.
2. Regions. The windows that chose one anchor span a region of at most 2 x
   width bytes. Regions whose anchor occurs again are written, with the text's
   key and the place; a task writes the bytes of equal regions once.
3. Merge. Regions meet by anchor. Regions that occur twice repeat as a whole.
   Of the rest, shards of regions get their Burrows-Wheeler transforms over
   50-byte symbols, and the shards' transforms are merged: each round of
   refinement reads the transforms in the order of the interleave and deals
   them out by symbol, so that after h rounds suffixes are in order by their
   first h symbols. A border between neighbours that appears in round h means
   a common prefix of h - 1 symbols. Intervals without a border after ``width``
   bytes repeat. No suffix is sorted again.
4. Repeated windows go back to the texts by region key, and texts are cut.

Anchors of over ``HOT`` occurrences would fill a task with regions that differ
at their sides only. Such a region goes in pieces, each for the windows that
have the anchor at 16 neighbouring places; the bytes that all these windows
share are the piece's anchor, so equal windows still meet. A piece whose anchor
is as frequent goes window by window, and its pieces are whole windows. Pieces
are merged as regions are.

Edge cases: a null text is empty; texts shorter than ``width`` bytes lose
nothing. Texts are known by a 128-bit hash, so repeated rows and null or
repeated ids make no difference; equal texts are cut alike, and each counts as
the other's repeat. An empty table gives an empty result. ``cut_spans``
ignores other columns; ``without_repeats`` keeps them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, complete_runs, materialize, one_array, regrouped, table

WIDTH = 200
GRAM = 64
SYMBOL = 50
HOT = 50_000
#: Places of the anchor in the windows of a piece of a frequent region, and of a piece of such a piece.
PIECES = (16, 1)
SHARDS = 4
BATCH_BYTES = 4 << 20
MERGE_BYTES = 1 << 18
CHUNK = 1 << 17
PLACE = (1 << 20) - 1
FACTOR = 0x9FB21C651E98DF25


def _byte_values() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)


BYTE_VALUES = _byte_values()


def string_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every string of ``length`` bytes, by doubling."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, have, have_len, out, out_len = BYTE_VALUES[buf], None, 1, None, 0
    have, k = power, length
    while True:
        if k & 1:
            if out is None:
                out, out_len = have, have_len
            else:
                m = len(buf) - out_len - have_len + 1
                out = out[:m] * np.uint64(pow(FACTOR, have_len, 1 << 64)) + have[out_len:out_len + m]
                out_len += have_len
        k >>= 1
        if not k:
            return out[:n]
        m = len(buf) - 2 * have_len + 1
        have = have[:m] * np.uint64(pow(FACTOR, have_len, 1 << 64)) + have[have_len:have_len + m]
        have_len *= 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first and last window start) of each run of
    windows that choose one anchor; places are in ``buf``."""
    n = len(buf)
    out: list[tuple[np.ndarray, ...]] = []
    per_window = width - gram + 1
    ends = offs[1:]
    for a in range(0, n - width + 1, CHUNK):
        piece = buf[a:a + CHUNK + width - 1]
        g = _mixed(string_hashes(piece, gram))
        least = (g & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64)
        span = 1
        while span * 2 <= per_window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if per_window > span:
            least = np.minimum(least[:len(least) - (per_window - span)], least[per_window - span:])
        chosen = (least & np.uint64(PLACE)).astype(np.int64)
        # windows inside one text
        first = int(np.searchsorted(ends, a, side="right"))
        last = int(np.searchsorted(offs, a + len(chosen), side="left"))
        inside = np.zeros(len(chosen) + 1, np.int32)
        lo = np.clip(offs[first:last] - a, 0, len(chosen))
        hi = np.clip(np.maximum(offs[first + 1:last + 1] - width + 1, offs[first:last]) - a, 0, len(chosen))
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        ok = np.cumsum(inside[:-1]) > 0
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (chosen[1:] != chosen[:-1])
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | (chosen[1:] != chosen[:-1])
        s, e = np.flatnonzero(new), np.flatnonzero(stop)
        out.append((g[chosen[s]], chosen[s] + a, s + a, e + a))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def pieces(raw: bytes, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first and last window start, region) of the
    pieces of regions: those of the windows that have the anchor at ``step``
    neighbouring places. The bytes that the windows of a piece share, with
    where the anchor lies in them, are its anchor."""
    import xxhash

    first, last = (place - hi) // step, (place - lo) // step
    of = np.repeat(np.arange(len(place)), last - first + 1)
    k = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
    a, b = np.maximum(lo[of], place[of] - step * k - (step - 1)), np.minimum(hi[of], place[of] - step * k)
    core = place[of] - step * k
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], seed=z) for x, y, z in zip(core.tolist(), (core - (step - 1) + width).tolist(), (k * 256 + step).tolist())), np.uint64, len(of))
    return h, place[of], a, b, of


def filter_words(hashes: DataFrame, n_blocks: int) -> np.ndarray:
    """A blocked Bloom filter of the column ``gram``, ``n_blocks`` x 8 longs."""
    masks = [F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(gram, {16 + 6 * w}) & 63 as int)))") for w in range(8)]
    out = np.zeros((n_blocks, 8), np.int64)
    for row in hashes.groupBy(F.col("gram").bitwiseAND(F.lit(n_blocks - 1)).alias("b")).agg(*masks).toLocalIterator():
        out[row[0]] = row[1:]
    return out.view(np.uint64)


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    line = words[(h & np.uint64(len(words) - 1)).astype(np.int64)]
    hit = np.ones(len(h), bool)
    for w in range(8):
        hit &= (line[:, w] >> ((h >> np.uint64(16 + 6 * w)) & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _sized_filter(hashes: DataFrame, most_bytes: int) -> np.ndarray:
    n = hashes.count()
    blocks = 1
    while blocks * 32 < n and blocks * 128 <= most_bytes:
        blocks *= 2
    return filter_words(hashes, blocks)


# ---- the merge -----------------------------------------------------------------------------------------------------

def shard_transform(strings: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, Burrows-Wheeler transform) of a shard's strings:
    ``strings`` holds their symbols, each string ended by 0; ``starts`` are
    the places of the strings' first symbols. Suffixes are in order by
    ``depth`` symbols."""
    n = len(strings)
    order = np.arange(n)
    padded = np.concatenate([strings, np.zeros(depth, strings.dtype)])
    # what follows a string's end is no part of its suffixes
    alive = np.ones(n, bool)
    keys = []
    for d in range(depth):
        keys.append(np.where(alive, padded[d:d + n], 0))
        alive &= padded[d:d + n] != 0
    for key in reversed(keys):
        order = order[np.argsort(key[order], kind="stable")]
    before = np.concatenate([[0], strings[:-1]])
    before[starts] = 0
    return order, before[order]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefix with the one before) of all shards' suffixes,
    in order by ``rounds`` symbols: the interleave names the shard of each
    suffix; a common prefix of ``rounds`` means that or more."""
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    interleave = np.repeat(np.arange(len(transforms), dtype=np.int32), sizes)
    block = np.zeros(n, np.int64)
    lcp = np.full(n, rounds, np.int64)
    symbols = np.empty(n, np.int64)
    for h in range(1, rounds + 1):
        for z, t in enumerate(transforms):
            symbols[interleave == z] = t
        order = np.argsort(symbols, kind="stable")
        sorted_symbols, sorted_block = symbols[order], block[order]
        interleave = interleave[order]
        border = np.ones(n, bool)
        border[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (sorted_block[1:] != sorted_block[:-1])
        # suffixes that have ended share nothing, and stay apart
        border |= sorted_symbols == 0
        block = np.cumsum(border) - 1
        lcp[border] = np.minimum(lcp[border], h - 1)
        lcp[~border] = rounds
    return interleave, lcp


def repeated_windows(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH, symbol: int = SYMBOL, shards: int = SHARDS) -> np.ndarray:
    """For each place of ``buf``, whether the ``width`` bytes from there on, in
    one of the regions between ``offs``, are found at another place too."""
    n, rounds = len(buf), width // symbol
    flags = np.zeros(n, bool)
    if n < symbol:
        return flags
    h = string_hashes(buf, symbol)
    ends = np.repeat(offs[1:], np.diff(offs))
    at = np.arange(len(h))
    whole = at + symbol <= ends[:len(h)]
    names = np.zeros(n, np.int64)
    _, inverse, count = np.unique(h[whole], return_inverse=True, return_counts=True)
    # a symbol that is found once is in no repeat: it ends a string
    names[:len(h)][whole] = np.where(count[inverse] > 1, inverse + 1, 0)
    # one string for each place of a region modulo the symbol's length; only windows of repeated symbols stay
    alive = names > 0
    window = alive.copy()
    for d in range(1, rounds):
        nxt = np.zeros(n, bool)
        nxt[:max(0, n - d * symbol)] = alive[d * symbol:]
        window &= nxt
    window &= np.arange(n) + width <= ends
    starts = np.flatnonzero(window)
    if len(starts) < 2:
        return flags
    used = np.zeros(n + width, bool)
    for d in range(rounds):
        used[starts + d * symbol] = True
    used = used[:n]
    head = used.copy()
    head[symbol:] &= ~used[:-symbol] | (ends[symbol:] != ends[:-symbol])
    place = np.flatnonzero(used)
    region = np.searchsorted(offs, place, side="right") - 1
    # order places by (region, phase, place), so that strings are contiguous
    phase = (place - offs[region]) % symbol
    order = np.lexsort((place, phase, region))
    place, region = place[order], region[order]
    first = head[place]
    # each string with its end symbol
    string = np.cumsum(first) - 1
    spot = np.arange(len(place)) + string
    total = len(place) + int(string[-1]) + 1
    shard_of_string = region[first] % shards
    symbols = np.zeros(total, np.int64)
    symbols[spot] = names[place]
    origin = np.full(total, -1, np.int64)
    origin[spot] = place
    owner = np.repeat(shard_of_string, np.diff(np.append(np.flatnonzero(first), len(place))) + 1)
    begins = np.zeros(total, bool)
    begins[spot[first]] = True
    transforms, orders, origins = [], [], []
    for z in range(shards):
        mine = np.flatnonzero(owner == z)
        if not len(mine):
            continue
        order, t = shard_transform(symbols[mine], np.flatnonzero(begins[mine]), rounds)
        transforms.append(t)
        orders.append(order)
        origins.append(origin[mine])
    interleave, lcp = merge_transforms(transforms, rounds)
    again = lcp >= rounds
    again[:-1] |= lcp[1:] >= rounds
    for z, (order, where) in enumerate(zip(orders, origins)):
        hit = where[order[again[interleave == z]]]
        flags[hit[hit >= 0]] = True
    return flags & window


def _groups(batches):
    """Sorted regions in tables of about ``MERGE_BYTES``, anchors whole."""
    for t, edges in complete_runs(batches, ["gram"]):
        offs = byte_view(one_array(t["region"]))[1]
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(offs[edges], offs[edges[a]] + MERGE_BYTES, side="right")) - 1)
            yield t.slice(edges[a], edges[b] - edges[a]).combine_chunks()
            a = b


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


# ---- the steps -----------------------------------------------------------------------------------------------------

TEXT_KEY = {"t1": lambda c: F.xxhash64(c), "t2": lambda c: F.xxhash64(F.lit(7), c)}
REGION_SCHEMA = "gram long, r1 long, r2 long, t1 long, t2 long, place int, n int, region binary"


def repeated_spans(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, most_filter_bytes: int = 16 << 20) -> DataFrame:
    """From ``t1``, ``t2`` and ``text``: (t1, t2, spans), the byte spans
    [from, to) of each text that repeated windows cover."""
    spark = texts.sparkSession

    def chosen(batches):
        for part in regrouped(batches, "text", BATCH_BYTES):
            buf, offs = byte_view(one_array(part["text"]))
            h, n = np.unique(anchors(buf, offs, width, gram)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    repeated = materialize(texts.select("text").mapInArrow(chosen, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    # the filters take 16 bits an anchor, and most_filter_bytes each at most; a fuller one only lets more regions through
    shared = spark.sparkContext.broadcast((_sized_filter(repeated, most_filter_bytes), _sized_filter(repeated.where(F.col("n") > hot), most_filter_bytes)))
    any_hot = not repeated.where(F.col("n") > hot).isEmpty()

    def cut_finer(raw, h, place, lo, hi, often, step):
        """The frequent ones in pieces, the others as they are."""
        hit = in_filter(often, h)
        piece = pieces(raw, place[hit], lo[hit], hi[hit], step, width)[:4]
        return tuple(np.concatenate([x[~hit], y]) for x, y in zip((h, place, lo, hi), piece))

    finest = None
    if any_hot:
        def counted(batches):
            for part in regrouped(batches, "text", BATCH_BYTES):
                buf, offs = byte_view(one_array(part["text"]))
                h, place, lo, hi = anchors(buf, offs, width, gram)
                hit = in_filter(shared.value[1], h)
                h, n = np.unique(pieces(buf.tobytes(), place[hit], lo[hit], hi[hit], PIECES[0], width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

        frequent = materialize(texts.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > hot), "frequent-pieces")
        finest = spark.sparkContext.broadcast(_sized_filter(frequent, most_filter_bytes))

    def regions(batches):
        import xxhash

        again, often = shared.value
        for part in regrouped(batches, "text", BATCH_BYTES):
            buf, offs = byte_view(one_array(part["text"]))
            h, place, lo, hi = anchors(buf, offs, width, gram)
            keep = in_filter(again, h)
            h, place, lo, hi = h[keep], place[keep], lo[keep], hi[keep]
            raw = buf.tobytes()
            if finest is not None:
                h, place, lo, hi = cut_finer(raw, h, place, lo, hi, often, PIECES[0])
                h, place, lo, hi = cut_finer(raw, h, place, lo, hi, finest.value, PIECES[1])
            doc = np.searchsorted(offs, lo, side="right") - 1
            keys = np.frombuffer(bytes(0) if not len(h) else b"".join(xxhash.xxh3_128_digest(raw[a:b], seed=c) for a, b, c in
                                          zip(lo.tolist(), (hi + width).tolist(), (place - lo).tolist())), "<i8").reshape(-1, 2)
            # the bytes go with the first of equal regions
            _, first, back, count = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True) if len(keys) else (None, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
            is_first = np.zeros(len(h), bool)
            is_first[first] = True
            n = np.zeros(len(h), np.int32)
            n[first] = count
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), one_array(part["t1"]).take(pa.array(doc)), one_array(part["t2"]).take(pa.array(doc)),
                 pa.array((lo - offs[doc]).astype(np.int32)), pa.array(n),
                 pa.array([raw[a:b] if f else None for a, b, f in zip(lo.tolist(), (hi + width).tolist(), is_first.tolist())], pa.binary())],
                [x.split()[0] for x in REGION_SCHEMA.split(", ")])

    places = materialize(texts.select("t1", "t2", "text").mapInArrow(regions, REGION_SCHEMA), "regions")
    bodies = places.where("region is not null")

    def merged(batches):
        for t in _groups(batches):
            # regions are in order by key in each anchor: equal ones are neighbours
            k1, k2, g = t["r1"].to_numpy(), t["r2"].to_numpy(), t["gram"].to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (g[1:] != g[:-1])
            start = np.flatnonzero(new)
            total = np.add.reduceat(t["n"].to_numpy().astype(np.int64), start)
            one = t.take(pa.array(start)).combine_chunks()
            g = g[start]
            buf, offs = byte_view(one_array(one["region"]))
            several = np.zeros(len(g), bool)
            several[1:] |= g[1:] == g[:-1]
            several[:-1] |= g[1:] == g[:-1]
            flags = np.zeros(len(buf), bool)
            some = np.flatnonzero(several)
            if len(some):
                sub, sub_offs = byte_view(one_array(one["region"]).take(pa.array(some)))
                found = repeated_windows(sub, sub_offs, width)
                for k, a, b in zip(some.tolist(), sub_offs[:-1].tolist(), sub_offs[1:].tolist()):
                    flags[offs[k]:offs[k + 1]] = found[a:b]
            for k in np.flatnonzero(total > 1).tolist():
                flags[offs[k]:offs[k + 1] - width + 1] = True
            a, b = _spans(flags)
            r = np.searchsorted(offs, a, side="right") - 1
            yield pa.RecordBatch.from_arrays([one_array(one["r1"]).take(pa.array(r)), one_array(one["r2"]).take(pa.array(r)),
                                              pa.array((a - offs[r]).astype(np.int32)), pa.array((b - offs[r] - 1 + width).astype(np.int32))], ["r1", "r2", "a", "b"])

    usual = (bodies.select("gram", "r1", "r2", "n", "region").repartition("gram").sortWithinPartitions("gram", "r1", "r2")
             .mapInArrow(merged, "r1 long, r2 long, a int, b int"))
    # as a table, both sides of the join are plain shuffles, so that Spark can split the places of a frequent region
    found = materialize(usual.groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b")).alias("found")), "found-spans")
    spans = (places.select("r1", "r2", "t1", "t2", "place").join(found, ["r1", "r2"])
             .select("t1", "t2", F.explode(F.transform("found", lambda x: F.struct((x["a"] + F.col("place")).alias("a"), (x["b"] + F.col("place")).alias("b")))).alias("s")))
    return spans.groupBy("t1", "t2").agg(F.collect_set("s").alias("spans"))


def _cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(removed bytes, removed runs, what is left) of a text and its spans."""
    if not len(begin):
        return 0, 0, raw
    cover = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), len(_spans(gone)[0]), raw[~gone]


def _texts_and_spans(batch: pa.RecordBatch, text: int, spans: int):
    """Of each row: its place, the text's bytes, and where its spans begin and end."""
    buf, offs = byte_view(batch.column(text))
    lists = batch.column(spans)
    flat = lists.flatten()
    begin, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(n)])
    for k in range(batch.num_rows):
        yield k, buf[offs[k]:offs[k + 1]], begin[at[k]:at[k + 1]], end[at[k]:at[k + 1]]


def _with_spans(docs: DataFrame, keep: dict, text_col: str, **options) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], text.alias("_text")).withColumns({k: f(F.col("_text")) for k, f in TEXT_KEY.items()})
    spans = repeated_spans(rows.select("t1", "t2", F.col("_text").alias("text")), **options)
    return rows.join(spans, ["t1", "t2"], "left")


def cut_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the
    SHA-256 of the remaining bytes."""
    rows = _with_spans(docs, {"doc_id": F.col(id_col)}, text_col, **options).select("doc_id", "_text", "spans")

    def cut(batches):
        for batch in batches:
            got = []
            for _, raw, begin, end in _texts_and_spans(batch, 1, 2):
                removed, runs, left = _cut(raw, begin, end)
                got.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in got], pa.string() if k == 3 else pa.int64()) for k in range(4))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated bytes cut from their text, columns
    unchanged. A character that lost some of its bytes is dropped whole; a text
    that is nothing but repeats becomes empty; a null text stays null."""
    rows = _with_spans(docs, {"_row": F.struct(*docs.columns)}, text_col, **options).select("_row", "_text", "spans")

    def cut(batches):
        for batch in batches:
            row = batch.column(0)
            names = [f.name for f in row.type]
            at = row.type.get_field_index(text_col)
            text = row.field(at).to_pylist()
            for k, raw, begin, end in _texts_and_spans(batch, 1, 2):
                if len(begin):
                    text[k] = _cut(raw, begin, end)[2].tobytes().decode("utf-8", "ignore")
            fields = [pa.array(text, row.type[k].type) if k == at else row.field(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(fields, names)

    return rows.mapInArrow(cut, docs.schema)


def op3_suffix_merge(spark, sf_dir) -> DataFrame:
    return cut_spans(table(spark, sf_dir, "documents"))
