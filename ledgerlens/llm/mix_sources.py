"""Mixing sources to target weights (operator 2): Pareto order sampling.

A source's target divided by its size is the number of copies that each of its
words should get. Its whole part is certain: so many copies of every document.
The rest is a sample: every document gets a rank, random odds divided by
inclusion odds, and the lowest ranks are taken until their words fill what is
left of the target. Everything runs on DataFrame functions.

Inclusion probabilities are unequal: they are proportional to a document's
weight, which is its size to the power of ``size_power`` (0.5: a document of
four times the words is twice as likely), times ``weight_col`` if there is one;
they add up to what is left of the target in words. A document whose words are
over ``long_share`` of what the sample should take has its probability cut in
proportion, since one such document would overshoot the target, and the others'
is raised to match.

The fill point of a source is found by refining a histogram over the ranks:
words are summed by (source, 1/4096 of the rank interval), the slot that holds
the fill point is cut again, three times over; then the few rows of the last
slot are added up one by one. So no source's documents are sorted in one task,
however many rows it has.

Edge cases: null text has size 0; null source is a source of its own, last in
order. Documents of size 0 take nothing. Ranks come from hashes of id, text
and seed, so reruns agree; identical rows tie and are taken together. An empty table gives an empty result. Other columns are
kept by ``mixed_documents`` and ignored by ``mix``."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, table

SLOTS = 4096
LEVELS = 3


def targets(sizes: list[tuple[str | None, int]], weights: list[int] = (1, 2, 3), most_copies: int = 3) -> list[Fraction]:
    """Each source's target: weighted shares of all sizes, capped at
    ``most_copies`` times its own size; the excess is shared again by weight
    until no source is above. ``sizes`` is in order; one entry a source."""
    total = Fraction(sum(s for _, s in sizes))
    w = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list[Fraction | None] = [None] * len(sizes)
    left = total
    while True:
        free = [i for i in range(len(sizes)) if out[i] is None]
        if not free:
            break
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if unit * w[i] > most_copies * sizes[i][1]]
        if not over:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = Fraction(most_copies * sizes[i][1])
            left -= out[i]
    return [x if x is not None else Fraction(0) for x in out]


PLAN = "source string, source_size long, target double, whole int, rest double, per_mass double, raised double, cut double"


#: How inclusion probabilities grow with a document's size.
SIZE_POWER = 0.5


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight_col: str | None, size_power: float = SIZE_POWER) -> DataFrame:
    """The documents with ``_source``, ``_size``, ``_weight`` and a uniform number ``_u``."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(source_col), F.xxhash64(text_col), F.lit(seed)), 12).cast("double")
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.withColumns({"_source": F.col(source_col).cast("string"), "_size": n_words(F.col(text_col).cast("string")),
                             "_weight": weight, "_u": (u + 0.5) / float(1 << 52)})
    return rows.withColumn("_weight", F.col("_weight") * F.pow(F.col("_size").cast("double"), F.lit(float(size_power))))


def with_plan(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """Each row with its source's plan; the plan has one row a source."""
    aim = rows.sparkSession.createDataFrame(plan, PLAN).select("source", F.struct("*").alias("_aim"))
    return rows.join(F.broadcast(aim), F.col("_source").eqNullSafe(aim["source"])).drop(aim["source"])


def _first(long_share: float) -> tuple[Column, Column]:
    """A document's share of what is left to sample, and that share cut for long documents."""
    fair = F.least(F.col("_aim.per_mass") * F.col("_weight"), F.lit(1.0))
    room = F.lit(long_share) * F.col("_aim.rest")
    return fair, F.when(fair * F.col("_size") > room, room / F.col("_size")).otherwise(fair)


def _rank(long_share: float) -> Column:
    """Random odds divided by inclusion odds, mapped to (0, 1) in the same order."""
    fair, cut = _first(long_share)
    p = F.least(F.greatest(F.when(cut < fair, cut).otherwise(cut * F.col("_aim.raised")), F.lit(1e-9)), F.lit(1.0 - 1e-9))
    odds = (F.col("_u") / (1.0 - F.col("_u"))) / (p / (1.0 - p))
    return odds / (1.0 + odds)


def _copies(long_share: float) -> Column:
    return (F.col("_aim.whole") + (F.col("_rank") <= F.col("_aim.cut")).cast("int")).cast("int")


def mixing_plan(rows: DataFrame, weights=(1, 2, 3), most_copies: int = 3, long_share: float = 0.02) -> list[tuple]:
    """One ``PLAN`` row a source from rows that ``sized`` made. The driver
    holds sums by source and slot, never documents."""
    spark = rows.sparkSession
    by_source = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.sum(F.col("_weight") * F.col("_size")).alias("mass")).collect()
    # UTF-8 bytes order as code points do
    order = sorted(by_source, key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    plan = {}
    for r, t in zip(order, targets([(r["_source"], r["size"]) for r in order], weights, most_copies)):
        whole = int(min(most_copies, t // r["size"])) if r["size"] else 0
        rest = float(t - whole * r["size"])
        plan[r["_source"]] = [r["_source"], int(r["size"]), float(t), whole, rest, rest / r["mass"] if r["mass"] else 0.0, 1.0, -1.0]
    # what long documents lose, the others gain
    rows = rows.where("_size > 0")
    fair, cut = _first(long_share)
    lost = (with_plan(rows, [tuple(x) for x in plan.values()]).groupBy("_source")
            .agg(F.sum(F.when(cut >= fair, cut * F.col("_size"))).alias("fair"), F.sum(F.when(cut < fair, cut * F.col("_size"))).alias("cut")))
    for r in lost.collect():
        x = plan[r["_source"]]
        x[6] = float((x[4] - (r["cut"] or 0.0)) / r["fair"]) if r["fair"] else 1.0
    # the slot in which a source's words reach what is left of its target, cut again and again
    ranked = with_plan(rows, [tuple(x) for x in plan.values() if x[4] > 0]).select(
        "_source", "_size", _rank(long_share).alias("_rank"), F.col("_aim.rest").alias("_rest"))
    inside = {k: (0.0, 1.0, 0.0) for k, x in plan.items() if x[4] > 0}  # start and width of the interval, words before it

    def within(state: dict) -> DataFrame:
        at = spark.createDataFrame([(k, *v) for k, v in state.items()], "source string, lo double, width double, before double")
        return (ranked.join(F.broadcast(at), ranked["_source"].eqNullSafe(at["source"])).drop("source")
                .where("_rank >= lo and _rank < lo + width").withColumn("goal", F.col("_rest") - F.col("before")))

    for _ in range(LEVELS):
        if not inside:
            break
        slots = (within(inside)
                 .withColumn("slot", F.least(F.floor((F.col("_rank") - F.col("lo")) / F.col("width") * SLOTS), F.lit(SLOTS - 1)).cast("int"))
                 .groupBy("_source", "slot").agg(F.sum("_size").alias("words"), F.max("goal").alias("goal"))
                 .withColumn("until", F.sum("words").over(Window.partitionBy("_source").orderBy("slot"))))
        found = {r["_source"]: r["f"] for r in slots.where("until >= goal").groupBy("_source")
                 .agg(F.min(F.struct("slot", (F.col("until") - F.col("words")).alias("before"))).alias("f")).collect()}
        for k in set(inside) - set(found):
            plan[k][7] = 2.0  # all of the source is needed
        inside = {k: (inside[k][0] + inside[k][1] * f["slot"] / SLOTS, inside[k][1] / SLOTS, inside[k][2] + f["before"]) for k, f in found.items()}
    if inside:
        # the last slot's rows one by one: taken while that brings the source nearer to its target
        for k, (lo, _, _) in inside.items():
            plan[k][7] = math.nextafter(lo, -1.0)
        # equal ranks are taken together
        edge = (within(inside).groupBy("_source", "_rank").agg(F.sum("_size").alias("_size"), F.max("goal").alias("goal"))
                .withColumn("until", F.sum("_size").over(Window.partitionBy("_source").orderBy("_rank")))
                .where(F.col("until") - F.col("_size") / 2 <= F.col("goal")).groupBy("_source").agg(F.max("_rank").alias("cut")))
        for r in edge.collect():
            plan[r["_source"]][7] = r["cut"]
    return [tuple(x) for x in plan.values()]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3),
        most_copies: int = 3, seed: int = 20, long_share: float = 0.02, weight_col: str | None = None, size_power: float = SIZE_POWER) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words
    taken, repeats counted) and copies (of the whole document)."""
    rows = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
                             *([] if weight_col is None else [F.col(weight_col).alias("weight")])), "doc_id", "text", "source", seed,
                 None if weight_col is None else "weight", size_power).select("doc_id", "_source", "_size", "_weight", "_u")
    rows = materialize(rows, "mix-sizes")
    got = with_plan(rows, mixing_plan(rows, weights, most_copies, long_share)).withColumn("_rank", _rank(long_share)).withColumn("copies", _copies(long_share))
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_aim.source_size").alias("source_size"), F.col("_aim.target").alias("target"),
                      (F.col("copies") * F.col("_size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3),
                    most_copies: int = 3, seed: int = 20, long_share: float = 0.02, weight_col: str | None = None, size_power: float = SIZE_POWER) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = sized(rows, f"_row.{id_col}", f"_row.{text_col}", f"_row.{source_col}", seed, None if weight_col is None else f"_row.{weight_col}", size_power)
    plan = mixing_plan(materialize(rows.select("_source", "_size", "_weight", "_u"), "mix-sizes"), weights, most_copies, long_share)
    got = with_plan(rows, plan).withColumn("_rank", _rank(long_share)).withColumn("_copies", _copies(long_share))
    return got.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op2_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
