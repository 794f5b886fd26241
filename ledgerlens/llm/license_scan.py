"""License scans (operator 11): ordered signature rules behind a keyword prefilter.

A text is normalised to its words in lower case, one space between them. One
Aho-Corasick automaton over all rules' keywords goes through it; only rules
whose keyword occurs as whole words run their regular expression. Detections
that overlap are resolved by priority: one that lies inside an interval kept
from an earlier tier, or inside a longer one of its own tier, is suppressed.
What overlaps without lying inside stays.

A text is handled in one Arrow batch, in memory linear in its length; nothing
is shuffled. Edge cases: a null or empty text has no words and no detections.
Rows are scanned one by one: repeated rows and null ids give a row each. Other
columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, one_array, regrouped, table, worker_state
from .license_rules import BASE, WEIGHT, Rule, default_rules

DETECTION = "struct<rule: string, label: string, priority: int, start: bigint, length: bigint, kept: boolean>"
BATCH_BYTES = 4 << 20

#: A-Z to a-z; ASCII that is neither letter nor digit to a space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[:48] = LOWER[58:65] = LOWER[91:97] = LOWER[123:128] = 32


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, words of each text): every text as its words with a
    space after each."""
    x = LOWER[buf]
    inside = x != 32
    last = inside.copy()  # the last byte of a word
    last[:-1] &= ~inside[1:]
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = inside[ends]
    keep = inside.astype(np.int8)
    keep[last] = 2
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    out = np.full(at[-1], 32, np.uint8)
    out[at[:-1][inside]] = x[inside]
    n = np.concatenate([[0], np.cumsum(last, dtype=np.int64)])
    return out, at[offs], np.diff(n[offs])


class Scanner:
    """Rules and the automaton of their keywords, in a Python worker."""

    def __init__(self, rules: list[Rule], gated: bool = True):
        import ahocorasick

        self.rules, self.gated = sorted(rules, key=lambda r: r.priority), gated
        by_key: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                by_key.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, which in by_key.items():
            self.automaton.add_word(f" {k} ", tuple(which))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules of which a keyword occurs, in order; ``text`` has a space on both ends."""
        if not self.gated:
            return list(range(len(self.rules)))
        found = {which for _, which in self.automaton.iter(text)}
        return sorted({i for which in found for i in which})

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, words, rule) of every match, by start."""
        hits = sorted((m.start(), m.end(), i) for i in self.candidates(text) for m in self.rules[i].regex.finditer(text))
        out, at, words = [], 1, 0
        for a, b, i in hits:
            words += text.count(" ", at, a)
            at = a
            out.append((words, text.count(" ", a, b) + 1, i))
        return out

    def kept(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Which detections no other one suppresses."""
        verdict = [True] * len(found)
        starts: list[int] = []  # of the intervals kept from earlier tiers
        reach: list[int] = []  # the farthest end among the intervals up to that start
        tier: list[tuple[int, int]] = []
        order = sorted(range(len(found)), key=lambda j: (self.rules[found[j][2]].priority, found[j][0], -found[j][1], found[j][2]))
        before, far = None, -1
        for j in order:
            start, length, i = found[j]
            if self.rules[i].priority != before:
                both = sorted([*zip(starts, reach), *tier])
                starts, reach, high = [x for x, _ in both], [], -1
                for _, end in both:
                    high = max(high, end)
                    reach.append(high)
                tier, before, far = [], self.rules[i].priority, -1
            k = bisect_right(starts, start) - 1
            if far >= start + length or k >= 0 and reach[k] >= start + length:
                verdict[j] = False
                continue
            far = max(far, start + length)
            tier.append((start, start + length))
        return verdict


def _scan(rules: list[Rule], schema: pa.Schema, gated: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_state(f"licenses_{hash((tuple(rules), gated))}", lambda: Scanner(rules, gated))
        for t in regrouped(batches, "_text", BATCH_BYTES):
            raw, offs, n = normalised(*byte_view(one_array(t["_text"])))
            lists = []
            for a, b in zip(offs, offs[1:]):
                text = " " + raw[a:b].tobytes().decode("latin-1")  # a character a byte: patterns are ASCII
                found = scanner.detections(text)
                lists.append([{"rule": scanner.rules[i].name, "label": scanner.rules[i].label, "priority": scanner.rules[i].priority,
                               "start": start, "length": length, "kept": ok} for (start, length, i), ok in zip(found, scanner.kept(found))])
            yield from pa.Table.from_arrays([one_array(t["_id"]), pa.array(n), pa.array(lists, schema.field(2).type)], schema=schema).to_batches()

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, gated: bool = True) -> DataFrame:
    """One row per document: id, n_words and ``detections``, an array of
    (rule, label, priority, start, length, kept) by start; start and length are
    in words. ``gated=False`` runs every rule on every text (for tests)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = f"_id {rows.schema['_id'].dataType.simpleString()}, n_words bigint, detections array<{DETECTION}>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.mapInArrow(_scan(default_rules() if rules is None else rules, schema, gated), out).withColumnRenamed("_id", id_col)


def op11_license_scan(spark, sf_dir) -> DataFrame:
    """Every document's license labels. The base phrases are the rules of the
    last tier: each of their places counts, suppressed or not. ``score`` is
    1 - the product of (1 - weight) over the tiers of the kept detections."""
    got = scan(table(spark, sf_dir, "documents"))
    got = got.withColumns({
        "_base": F.filter("detections", lambda d: d["priority"] == BASE),
        "_any": F.filter("detections", lambda d: d["kept"] | (d["priority"] == BASE)),
    })
    starts = F.transform("_base", lambda d: d["start"])
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])
    doubt = F.aggregate(F.array_distinct(F.transform("_any", lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority")))),
                        F.lit(1.0), lambda a, d: a * (1 - weight[d["priority"]]))

    def joined(detections: str):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    return got.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                      F.array_max(starts).alias("last_word"), joined("_base").alias("base_labels"), joined("_any").alias("labels"),
                      (1 - doubt).alias("score"))
