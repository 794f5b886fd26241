"""SimHash near-duplicates (operator 5): a byte-position inverted index with
count filtering.

Fingerprints that differ in at most d bits share at least 8 - d of their 8
positional bytes. The index lists each distinct fingerprint by the bytes at
chosen positions: the positions are four neighbouring pairs, and a list leaves
out d of the pairs, so that every pair of fingerprints that shares 8 - d bytes
meets in a list at least (for d = 2 there are six lists of four joined bytes a
fingerprint; lists of single bytes would hold a 256th of all). In a list the
shared positional bytes of each pair are tallied; pairs that reach the
guaranteed minimum of 8 - d are retained, and their bits are compared.

A list of more than ``LONG`` members is cut: its members are listed again by
all choices of 8 - d positions that the list allows. Such a list has 256 ** d
members at most (65,536 for two), since they differ in d bytes only. Lists are
tallied a block at a time and give a spanning forest of their links, never all
pairs. Equal fingerprints are one entry, so groups of copies cost one row.
Components are found over distinct fingerprints.

Edge cases: a null text is empty; a text without words has fingerprint zero
and links like any other; fewer words than the shingle are one shingle. An
empty table gives an empty result. Other columns are ignored by ``near_copies``
and kept by ``one_of_each``; where ids repeat or are null, each row counts, and
nulls never name a component unless all ids of it are null."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, materialize, one_array, regrouped, table
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20
#: Of a long text, so much is split into words at a time.
TEXT_BYTES = 1 << 20
AT_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(raw: bytes, a: int, b: int, shingle: int):
    """Lists of the words of a text, about ``TEXT_BYTES`` of it at a time; each
    goes on from the last ``shingle`` - 1 words of the one before."""
    held: list[bytes] = []
    while a < b:
        stop = min(a + TEXT_BYTES, b)
        if stop < b:
            space = AT_SPACE.search(raw, stop, b)
            stop = space.start() if space else b
        words = held + raw[a:stop].split()
        yield words
        held = words[max(0, len(words) - shingle + 1):]
        a = stop


def _fingerprints(buf: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each text (lower-cased bytes)."""
    import xxhash

    out = np.zeros(len(offs) - 1, np.uint64)
    raw = buf.tobytes()
    digest = xxhash.xxh64_intdigest
    shifts = np.arange(64, dtype=np.uint64)
    for k in range(len(out)):
        bits, n, few = np.zeros(64, np.int64), 0, []
        for w in _words(raw, int(offs[k]), int(offs[k + 1]), shingle):
            few = w
            if len(w) < shingle:
                continue
            # the words joined by single spaces; a shingle is a slice of that
            line = b" ".join(w)
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            begin = np.concatenate([[0], ends[:len(w) - shingle]]).tolist()
            stop = (ends[shingle - 1:] - 1).tolist()
            h = np.fromiter((digest(line[a:b], 42) for a, b in zip(begin, stop)), np.uint64, len(begin))
            n += len(h)
            for a in range(0, len(h), 1 << 16):
                bits += np.unpackbits(h[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if n:
            out[k] = np.bitwise_or.reduce(np.where(2 * bits > n, np.uint64(1) << shifts, np.uint64(0)))
        elif few:  # fewer words than a shingle
            out[k] = digest(b" ".join(few), 42)
    return out


def fingerprints(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", shingle: int = 3, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The columns ``keep`` and the fingerprint ``fp`` (long) of each row."""
    # bytes.split() parts at ASCII white space only
    rows = docs.select(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).cast("binary").alias("text"), *[c.alias(n) for n, c in keep.items()])

    names = list(keep)

    def hashed(batches):
        for part in regrouped(batches, "text", batch_bytes):
            buf, offs = byte_view(one_array(part["text"]))
            yield pa.RecordBatch.from_arrays([*(one_array(part[n]) for n in names), pa.array(_fingerprints(buf, offs, shingle).view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(hashed, ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", fp long")


#: Members of a list that is not cut, and pairs that are tallied at a time.
LONG = 4096
BLOCK = 1 << 20


def coarse_choices(max_bits: int) -> list[tuple[int, ...]]:
    """Positions that a list leaves out: ``max_bits`` of the pairs (0, 1), (2, 3), (4, 5), (6, 7)."""
    return [tuple(sorted(x for p in pairs for x in (2 * p, 2 * p + 1))) for pairs in combinations(range(4), min(max_bits, 4))]


def _listed(fps: DataFrame, choices: Column) -> DataFrame:
    """(choice, bytes, fp): ``choices`` is an array of masks of left-out bytes."""
    return fps.select("fp", F.explode(choices).alias("choice")).select("choice", F.col("fp").bitwiseAND(F.bitwise_not("choice")).alias("bytes"), "fp")


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _array(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes a pair shares, from its exclusive or."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def _linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs, by their exclusive or, that reach the least number of shared bytes and agree in the bits."""
    retained = _shared_bytes(x) >= 8 - max_bits
    out = np.zeros(x.shape, bool)
    out[retained] = np.bitwise_count(x[retained]) <= max_bits
    return out


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges to the smallest member of each component of one list."""
    fps = np.sort(fps)
    n = len(fps)
    root = np.arange(n)
    step = max(1, BLOCK // n)
    for a in range(0, n, step):
        i, j = np.nonzero(_linked(fps[a:a + step, None] ^ fps[None, a:], max_bits))
        i, j = i[i < j] + a, j[i < j] + a
        while len(i):  # all links of the block into the forest
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    moved = np.flatnonzero(root != np.arange(n))
    return list(zip(fps[root[moved]].view(np.int64).tolist(), fps[moved].view(np.int64).tolist()))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` within ``max_bits``
    bits: the members of a component of such links, over the lists, are
    connected by them."""
    coarse = coarse_choices(max_bits)
    # a small table, but each row makes several: dealt out before that
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    first = _listed(spread, _array([_mask(c) for c in coarse]))
    long = materialize(first.groupBy("choice", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("choice", "bytes"), "long-lists")
    short = first.join(long, ["choice", "bytes"], "left_anti")
    finer = F.create_map(*[x for c in coarse for x in (F.lit(_mask(c)).cast("long"), _array([_mask(f) for f in combinations(c, max_bits)]))])
    again = first.join(long, ["choice", "bytes"], "left_semi").select("fp", finer[F.col("choice")].alias("finer"))
    cut = _listed(again, F.col("finer")).distinct()  # lists of two long ones may be one
    lists = short.select("choice", "bytes", "fp").unionByName(cut).groupBy("choice", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def edges(batches):
        for batch in batches:
            found = []
            fps = batch.column(0)
            offs, flat = fps.offsets.to_numpy(), fps.values.to_numpy().view(np.uint64)
            two = np.flatnonzero(np.diff(offs) == 2)
            a, b = flat[offs[two]], flat[offs[two] + 1]
            near = _linked(a ^ b, max_bits)
            for k in np.flatnonzero(np.diff(offs) > 2):
                found += _forest(flat[offs[k]:offs[k + 1]], max_bits)
            x = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[near].view(np.int64), x[:, 0]])), pa.array(np.concatenate([b[near].view(np.int64), x[:, 1]]))], ["a", "b"])

    return lists.mapInArrow(edges, "a long, b long").distinct()


def classes(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root) for each distinct fingerprint: equal roots are one component."""
    roots = components(links(distinct, max_bits))
    return distinct.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    component_id (the smallest doc_id of its component)."""
    fps = materialize(fingerprints(docs, {"doc_id": F.col(id_col)}, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    by_fp = distinct.join(classes(distinct, max_bits), "fp")
    smallest = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = by_fp.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, that of the smallest id, columns
    unchanged. Of several rows with that id (or of rows without ids) the one
    with the smallest text hash stays, and of equal ones any."""
    key = {"id": F.col(id_col), "text_md5": F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))}
    fps = materialize(fingerprints(docs, key, text_col, shingle), "fingerprints")
    by_fp = classes(materialize(fps.select("fp").distinct(), "distinct-fingerprints"), max_bits)
    # the smallest of (no id, id, hash), and how many rows are that one
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_md5")
    counted = fps.groupBy("fp", first.alias("first")).agg(F.count("*").alias("n"))
    least = counted.groupBy("fp").agg(F.min(F.struct("first", "n")).alias("m"))
    winners = least.join(by_fp, "fp").groupBy("root").agg(F.min("m").alias("m")).select("m.first.id", "m.first.text_md5", "m.n")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key["id"].alias("_id"), key["text_md5"].alias("_md5"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_md5") == F.col("text_md5"))
    got = rows.join(winners, same).select("_row", "_id", "_md5", "n")
    return got.where("n = 1").select("_row.*").union(got.where("n > 1").groupBy("_id", "_md5").agg(F.first("_row").alias("_row")).select("_row.*"))


def op5_simhash(spark, sf_dir) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
