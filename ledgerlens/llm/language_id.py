"""Language ID (operator 1): language-bitmask n-gram filters.

Each language has the character n-grams that are frequent in it; all languages
share one bit-sliced Bloom filter, a table of rows with one bit a language. The
``and`` of an n-gram's rows is the set of all languages that have it. A text's
n-grams are counted for each language, the counts are corrected for the
filter's false positives, and the largest decides.

Texts are lower-cased; letters and one space between words remain. n-grams of
2 to 4 characters are used, with a space at an end but not inside.

Learning takes a bounded sample: about ``most_docs`` documents of each
language, by hash of id, and the ``most_grams`` most frequent n-grams of each
that are in ``least_share`` of its documents and not much more frequent in
another language. Prediction takes whole texts, long ones a part at a time, and
has no shuffle.

Edge cases: null text, or text without a letter, is ``und`` with score 0; with
no learned n-gram at all, the language with most learning documents is given
with score 0. Ties go to the language with more learning documents, then to the
first by name. Without labelled rows everything is ``und``. A null id is never
learned from and not held out. Other columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_array, regrouped, table, worker_state

SIZES = (2, 3, 4)
ROWS = 1 << 21
HASHES = 3
BATCH_BYTES = 4 << 20
#: Characters that are counted at a time, and where a long text may be cut: white space, or an
#: ideographic comma or full stop.
PART_CHARS = 2 << 20
BETWEEN_WORDS = re.compile("[\\s\u3001\u3002]")
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _letters() -> np.ndarray:
    return worker_state("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _plain(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between spaces, only letters and single
    spaces; and the end of each text."""
    points = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) for p in points])
    all_points = np.concatenate(points) if points else np.zeros(0, np.uint32)
    letter = _letters()[all_points]
    first = np.zeros(len(all_points), bool)
    first[ends[:-1]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the space after a word
    keep[0:1] = True
    keep |= first  # and one at the start of each text
    plain = np.where(letter, all_points, np.uint32(32))[keep]
    return plain, np.concatenate([[0], np.cumsum(keep)])[ends]


def _grams(plain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the n-grams without an inner space."""
    m = len(plain) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = plain == 32
    bad = space[:m] & space[n - 1:n - 1 + m] if n == 2 else np.zeros(m, bool)
    for j in range(1, n - 1):
        bad |= space[j:j + m]
    at = np.flatnonzero(~bad)
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ plain[at + j].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return at, h


def _rows(h: np.ndarray, k: int, n_rows: int) -> np.ndarray:
    return ((h * np.uint64(MULTIPLIERS[k])) >> np.uint64(20)) & np.uint64(n_rows - 1)


class Filter:
    """The bit-sliced filter: ``masks[row]`` has a bit for each language, in one
    word up to 64 languages and in columns of 64 bits past that."""

    def __init__(self, langs: list[str], n_rows: int = ROWS, masks: np.ndarray | None = None):
        self.langs = langs
        if masks is not None:
            self.masks = masks
            return
        kind = next((t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= most), np.uint64)
        self.masks = np.zeros(n_rows if len(langs) <= 64 else (n_rows, -(-len(langs) // 64)), kind)

    def _bits(self, masks: np.ndarray, lang: int) -> np.ndarray:
        """The bit of a language in each of ``masks``."""
        word = masks if masks.ndim == 1 else masks[:, lang // 64]
        return (word >> masks.dtype.type(lang % 64)) & masks.dtype.type(1)

    def add(self, lang: int, hashes: np.ndarray) -> None:
        bit = self.masks.dtype.type(1 << lang % 64)
        word = self.masks if self.masks.ndim == 1 else self.masks[:, lang // 64]
        for k in range(HASHES):
            word[_rows(hashes, k, len(self.masks))] |= bit

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """The bit mask of all languages that have each n-gram."""
        out = self.masks[_rows(hashes, 0, len(self.masks))]
        for k in range(1, HASHES):
            out = out & self.masks[_rows(hashes, k, len(self.masks))]
        return out

    def false_rate(self) -> np.ndarray:
        """By language, how often an n-gram that was not added is found."""
        return np.array([float(self._bits(self.masks, i).mean()) ** HASHES for i in range(len(self.langs))])

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its n-grams, those found by language, whether it has a letter."""
        plain, ends = _plain(texts)
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(self.langs), len(texts)), np.int64)
        for n in SIZES:
            at, h = _grams(plain, n)
            doc = np.searchsorted(ends, at, side="right")
            inside = np.searchsorted(ends, at + n - 1, side="right") == doc
            doc, h = doc[inside], h[inside]
            mask = self.languages(h)
            total += np.bincount(doc, minlength=len(texts))
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i in range(len(self.langs)):
                seen = np.concatenate([[0], np.cumsum(self._bits(mask, i), dtype=np.int64)])
                hits[i] += np.diff(seen[edges])
        # a text without a letter is only a space
        starts = np.concatenate([[0], ends[:-1]]) if len(texts) else np.zeros(0, np.int64)
        return total, hits, ends - starts > 1

    def decide(self, texts: list[str | None], prior: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        total, hits, has_letter = np.zeros(n, np.int64), np.zeros((len(self.langs), n), np.int64), np.zeros(n, bool)
        for owners, parts in _parts(texts):
            t, h, letter = self.counts(parts)
            np.add.at(total, owners, t)
            np.add.at(hits, (slice(None), owners), h)
            has_letter[owners[letter]] = True
        f = self.false_rate()[:, None]
        real = np.clip((hits - total * f) / (1.0 - f), 0.0, None) if len(self.langs) else np.zeros((1, n))
        # ties by prior, then by name: langs are in that order
        order = np.lexsort((np.arange(len(self.langs)), -prior)) if len(self.langs) else np.zeros(0, np.int64)
        best = order[np.argmax(real[order], axis=0)] if len(self.langs) else np.zeros(n, np.int64)
        score = np.where(has_letter & (total > 0), real[best, np.arange(n)] / np.maximum(total, 1), 0.0) if len(self.langs) else np.zeros(n)
        return [self.langs[b] if ok and self.langs else "und" for b, ok in zip(best, has_letter)], np.clip(score, 0.0, 1.0)


def _parts(texts: list[str | None]):
    """Lists of about ``PART_CHARS`` characters, with the number of each one's
    text. Long texts are cut where no n-gram and no rule of lower-casing reaches
    across; their counts add up."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        text, a = text or "", 0
        while True:
            b = len(text)
            if b - a > PART_CHARS - size and b - a > PART_CHARS // 4:
                cut = BETWEEN_WORDS.search(text, a + max(PART_CHARS - size, PART_CHARS // 4))
                b = cut.start() if cut else b
            owners.append(i)
            held.append(text[a:b])
            size += b - a
            a = b
            if size >= PART_CHARS:
                yield np.array(owners), held
                owners, held, size = [], [], 0
            if a >= len(text):
                break
    if held:
        yield np.array(owners), held


def learn(labelled: DataFrame, most_docs: int = 3000, most_grams: int = 30_000, least_share: float = 0.002, rival: float = 0.3,
          n_rows: int = ROWS) -> tuple[Filter, np.ndarray]:
    """The filter and each language's number of learning documents, from
    columns doc_id, text and lang.

    What the driver gets is bounded by languages x ``most_grams``."""
    spark = labelled.sparkSession
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    out = Filter(langs, n_rows)
    if not langs:
        return out, np.zeros(0)
    share = spark.createDataFrame([(x, i, min(1.0, most_docs / per_lang[x])) for i, x in enumerate(langs)], "lang string, at int, share double")
    sample = (labelled.join(F.broadcast(share), "lang")
              .where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("at", "text"))

    def counted(batches):
        for part in regrouped(batches, "text", BATCH_BYTES):
            lang = one_array(part["at"]).to_numpy()
            plain, ends = _plain(part["text"].to_pylist())
            got = []
            for n in SIZES:
                at, h = _grams(plain, n)
                doc = np.searchsorted(ends, at, side="right")
                inside = np.searchsorted(ends, at + n - 1, side="right") == doc
                doc, h = doc[inside], h[inside]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                got.append((lang[doc[new]], h[new]))
            a, h = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((h, a))
            a, h = a[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
            start = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(a[start].astype(np.int32)), pa.array(h[start].view(np.int64)),
                                              pa.array(np.diff(np.append(start, len(h))).astype(np.int64))], ["at", "gram", "docs"])

    sample_docs = {r["at"]: r["n"] for r in sample.groupBy("at").agg(F.count("*").alias("n")).collect()}
    n_docs = spark.createDataFrame([(k, v) for k, v in sample_docs.items()] or [(0, 1)], "at int, n long")
    rates = (sample.mapInArrow(counted, "at int, gram long, docs long").groupBy("at", "gram").agg(F.sum("docs").alias("docs"))
             .join(F.broadcast(n_docs), "at").select("at", "gram", (F.col("docs") / F.col("n")).alias("rate")))
    kept = (rates.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("rate") >= least_share) & (F.col("rate") >= rival * F.col("most")))
            .withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("rate"), "gram"))).where(F.col("place") <= most_grams).select("at", "gram"))
    got = kept.toArrow()
    at, gram = got["at"].to_numpy(), got["gram"].to_numpy().view(np.uint64)
    for i in range(len(langs)):
        out.add(i, gram[at == i])
    return out, np.array([per_lang[x] for x in langs], float)


def predict(docs: DataFrame, model: tuple[Filter, np.ndarray], keep: list, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of each row."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast((model[0].langs, model[0].masks, model[1]))

    def decided(batches):
        langs, masks, prior = shared.value
        filter_ = Filter(langs, masks=masks)
        for part in regrouped(batches, "_text", BATCH_BYTES):
            lang, score = filter_.decide(part["_text"].to_pylist(), prior)
            yield pa.RecordBatch.from_arrays([*(one_array(part[n]) for n in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(decided, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", lang_pred string, score double")


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out).select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    return predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
