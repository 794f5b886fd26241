"""Quality rules (operator 7): a learned decision list over text statistics.

The statistics are DataFrame expressions. ``learn_rules`` runs sequential
covering on labelled rows: a rule grows by the threshold condition of best
FOIL gain, is pruned on rows kept apart, and is accepted while it is precise;
the rows it covers leave, and the next rule is learned. The list is emitted as
one ordered conditional expression. Rules name the texts to reject, all others
are kept. Everything runs on DataFrame and SQL functions.

Edge cases: a null or empty text has no words and zero statistics, so the base
rule (under 50 words) rejects it. Ratios with a zero denominator are 0. Rows
are judged one by one: repeated rows and ids get the same verdict each. Null
labels are not learned from; without labels of both kinds the list is empty
and only the base rule acts. Other columns are ignored by ``judge`` and kept
by ``keep_good``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, table, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
#: What conditions can test.
FEATURES = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _others(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``_st``, a struct of the base counts and the features.

    The words in repeated 3-word windows: windows are hashed; where the
    distinct hashes are fewer than the windows, (hash, position) is sorted, so
    that equal windows are neighbours, and the union of the windows that have
    an equal neighbour is summed over sorted starts. Nothing leaves the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumns({"_w": words(F.col(text_col)), "_l": lines})
    df = df.withColumn("_h", F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"))
    df = df.withColumn("_z", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x, i))) END"))
    df = df.withColumn("_p", F.expr(
        "CASE WHEN _z IS NOT NULL THEN sort_array(transform(filter(transform(_z, (x, i) -> struct(x.i AS at,"
        " (i > 0 AND get(_z, i - 1).x = x.x) OR (get(_z, i + 1).x = x.x) AS again)), y -> y.again), y -> y.at)) ELSE array() END"))
    repeated = F.expr("CASE WHEN size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, (a, x) -> a + x) END")
    n = F.size("_w").cast("long")
    chars = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")
    df = df.withColumns({
        "_n": n, "_chars": chars, "_symbols": _others(text, SYMBOLS),
        "_dup": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_repeat": repeated,
    })
    n, chars = F.col("_n"), F.col("_chars")
    # letters that change when lowered are capitals
    st = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        _ratio(F.col("_symbols"), chars).alias("symbol_ratio"), _ratio(F.col("_repeat"), n).alias("repeat_ratio"),
        _ratio(F.col("_dup"), F.size("_l")).alias("dup_line_ratio"), _ratio(chars, n).alias("mean_word"),
        _ratio(_others(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars).alias("upper_ratio"),
        _ratio(_others(text, "!?"), chars).alias("mark_ratio"), _ratio(_others(text, "0123456789"), chars).alias("digit_ratio"),
        _ratio(F.size(F.array_distinct("_w")), n).alias("distinct_ratio"),
    )
    return df.withColumn("_st", st).drop("_w", "_l", "_h", "_z", "_p", "_n", "_chars", "_symbols", "_dup", "_repeat")


def computed_once(df: DataFrame) -> DataFrame:
    """``df``, such that filters above stay above its projections. A filter isn't pushed through a
    projection with an id of rows; pushed, it would hold a copy of the statistics' expressions for each
    place that uses them, and those inside lambdas would run once an element."""
    return df.withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0").drop("_at")


def base_failed(st: str = "_st") -> Column:
    n, again = F.col(f"{st}.n_words"), F.col(f"{st}.n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


Condition = tuple[str, str, float]


def condition(c: Condition, st: str = "_st") -> Column:
    name, op, value = c
    return F.col(f"{st}.{name}") <= F.lit(value) if op == "<=" else F.col(f"{st}.{name}") > F.lit(value)


def conjunction(conditions: list[Condition], st: str = "_st") -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & condition(c, st)
    return out


def rejects(rules: list[list[Condition]], st: str = "_st") -> Column:
    """The decision list as one ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(conjunction(rule, st), True) if out is None else out.when(conjunction(rule, st), True)
    return F.lit(False) if out is None else out.otherwise(False)


def learn_rules(labelled: DataFrame, bad: str = "bad", key: str = "key", n_cuts: int = 40, most_rules: int = 8,
                most_conditions: int = 3, precision: float = 0.97, least_cover: float = 0.002) -> list[list[Condition]]:
    """Ordered rules from rows with ``_st``, the boolean ``bad`` and a long
    ``key`` that splits them: two thirds grow rules, one third prunes them.

    Each step is one aggregate over the labelled rows, counted by feature and
    cut; only those counts (features x cuts) come to the driver."""
    edges: dict[str, list[float]] = {f: [] for f in FEATURES}
    shares = [i / n_cuts for i in range(n_cuts + 1)]
    for row in labelled.where(F.col(bad).isNotNull()).groupBy(bad).agg(*[F.percentile_approx(f"_st.{f}", shares, 10_000).alias(f) for f in FEATURES]).collect():
        for f in FEATURES:
            edges[f] += row[f] or []
    # a cut lies halfway between neighbouring values of either kind
    edges = {f: [(x + y) / 2 for x, y in zip(v, v[1:])] for f, v in ((f, sorted(set(v))) for f, v in edges.items())}
    rows = labelled.where(F.col(bad).isNotNull()).withColumn("_grow", F.pmod(F.col(key), F.lit(3)) != 0)
    rules: list[list[Condition]] = []
    left = rows

    def counts(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """By feature and number of cuts below the value: (bad, good) rows."""
        def slot(f: str) -> Column:
            return F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges[f]]), lambda e: e < F.col(f"_st.{f}")))

        slots = [F.struct(F.lit(f).alias("f"), slot(f).alias("slot")) for f in FEATURES if edges[f]]
        got: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        if slots:
            for r in (df.select(F.explode(F.array(*slots)).alias("s"), bad).groupBy("s.f", "s.slot")
                      .agg(F.sum(F.col(bad).cast("int")).alias("p"), F.sum((~F.col(bad)).cast("int")).alias("n")).toLocalIterator()):
                got[r["f"]][r["slot"]] = (r["p"], r["n"])
        return got

    for _ in range(most_rules):
        rule: list[Condition] = []
        grow = left.where("_grow")
        while len(rule) < most_conditions:
            got = counts(grow.where(conjunction(rule)))
            if not any(got.values()):
                break
            slots = next(x for x in got.values() if x)
            p0, n0 = (sum(x[i] for x in slots.values()) for i in (0, 1))
            if p0 == 0 or n0 == 0 and rule:
                break
            best, choice = 0.0, None
            for f in FEATURES:
                for i, edge in enumerate(edges[f]):
                    below = [sum(v[j] for s, v in got[f].items() if s <= i) for j in (0, 1)]
                    for op, (p, n) in (("<=", below), (">", [p0 - below[0], n0 - below[1]])):
                        if p == 0 or p + n == p0 + n0:
                            continue
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, choice = gain, (f, op, float(edge))
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            break
        # the shortest prefix of the best (bad - good) / covered on the rows kept apart
        aggs = []
        for k in range(1, len(rule) + 1):
            hit = conjunction(rule[:k])
            aggs += [F.sum((hit & F.col(bad)).cast("int")).alias(f"p{k}"), F.sum((hit & ~F.col(bad)).cast("int")).alias(f"n{k}")]
        prune = left.where("NOT _grow").agg(F.count("*").alias("all"), *aggs).first()
        worth = {k: ((prune[f"p{k}"] or 0) - (prune[f"n{k}"] or 0)) / max(1, (prune[f"p{k}"] or 0) + (prune[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda x: (worth[x], -x))
        p, n = prune[f"p{k}"] or 0, prune[f"n{k}"] or 0
        if p + n == 0 or p / (p + n) < precision or p < least_cover * prune["all"]:
            break
        rules.append(rule[:k])
        left = left.where(~conjunction(rule[:k]))
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_labelled: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of a sample of labelled documents, written as a table.

    About ``most_labelled`` labels (all of them if fewer) are picked by hash;
    that bounded sample is broadcast to the scan of the documents."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = max(1, one.count())
    share = int(min(1.0, most_labelled / total) * (1 << 30))
    picked = one.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = with_statistics(some.join(F.broadcast(picked), "doc_id"), "text")
    return materialize(got.select("_st", (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id", F.lit(12)).alias("key")), "labelled")


def learned(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, **options) -> list[list[Condition]]:
    return learn_rules(labelled_statistics(docs, labels, most_labelled, options.pop("id_col", "doc_id"), options.pop("text_col", "text"))
                       .where(~base_failed()), **options)


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, base_failed and kept."""
    got = computed_once(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text"))
    return (got.withColumn("base_failed", base_failed())
            .select("doc_id", *[F.col(f"_st.{x}").alias(x) for x in BASE], "base_failed",
                    F.when(F.col("base_failed"), False).otherwise(~rejects(rules)).alias("kept")))


def keep_good(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """The documents that the base rule and the list keep, columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"))
    return computed_once(with_statistics(rows, "text")).where(~base_failed() & ~rejects(rules)).select("_row.*")


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learned(docs, table(spark, sf_dir, "labels")))
