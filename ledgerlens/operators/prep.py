"""Model input preparation (inventory G1, G2).

The reference imputes numbers with the median and scales them to mean 0 and
population std 1, imputes categories with the most frequent value and one-hot
encodes them (an unseen category -> all zeros). MLlib's ``Imputer`` median is
approximate and ``StandardScaler`` uses the sample std, so the parameters
are fitted here as exact DataFrame aggregates. Fitting yields a small
parameter table (one row per feature, like any fitted model); ``transform``
turns it into plain column expressions, so scoring is one projection.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path, stored
from .quantiles import column_quantiles, grouped_quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, t in df.dtypes if (t in num or t.startswith("decimal")) and c not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def fit_numeric(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """(feature, median, mean, std): median of the observed values; mean and
    population std of the median-imputed column."""
    cols = list(cols)
    if method == "exact":
        med = column_quantiles(df, {c: (c, 0.5) for c in cols})
    else:
        med = grouped_quantiles(df, {c: (c, 0.5) for c in cols}, method=method).first().asDict()
    median = {c: F.lit(med[c]).cast("double") for c in cols}
    filled = {c: F.coalesce(F.col(c).cast("double"), median[c]) for c in cols}
    # sums of the columns as they are; only the one row of sums becomes a row a feature
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(filled[c]).alias(f"_m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(filled[c]).alias(f"_s{i}") for i, c in enumerate(cols)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), median[c].alias("median"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std")) for i, c in enumerate(cols)]))
    # rows come by their hash, as a grouping has them: models see the features in this order
    return sums.where("_n > 0").select(each.alias("_t")).select("_t.*").repartition("feature", "median")


#: A feature of up to so many values keeps them as a list, and its one-hot columns are expressions. The
#: values of any other one are a stored table: rows get their number by a join, and sparse vectors.
MAX_CATEGORIES = 10_000


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, v, n) of the observed values."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols]))
    return (df.select(stack.alias("_s")).select("_s.feature", "_s.v").where(F.col("v").isNotNull())
            .groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")))


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` with ``index``, the place of a value among its feature's
    sorted ones. Rows are sorted by ranges, and a range's first place comes from
    a table of (feature, range) sizes; no task holds a feature."""
    one = counts.repartitionByRange("feature", "v").sortWithinPartitions("feature", "v").withColumn("_at", F.monotonically_increasing_id())
    one = stored(one, "categories").withColumn("_part", F.shiftright("_at", 33))
    sizes = one.groupBy("feature", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("feature", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return (one.join(sizes, ["feature", "_part"]).withColumn("index", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_first", "_before"))


def fit_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mode, categories): most frequent observed value
    (smallest value on a tie) and the sorted list of observed values, null for a
    feature of over ``MAX_CATEGORIES`` of them."""
    return _modes(stored(category_counts(df, cols), "category-counts")).drop("n_values")


def _modes(counts: DataFrame) -> DataFrame:
    sizes = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))
    # a row a feature
    few = counts.join(F.broadcast(sizes.where(F.col("n_values") <= MAX_CATEGORIES).select("feature")), "feature")
    lists = few.groupBy("feature").agg(F.array_sort(F.collect_list("v")).alias("categories"))
    return sizes.join(lists, "feature", "left").select("feature", "mode", "n_values", "categories")


@dataclass
class Preparer:
    """Fitted preparation: numeric (median, mean, std) and categorical (mode,
    categories) parameters, as small local dicts. ``tables`` has the features of
    many values: (mode, number of values, folder of (v, index))."""

    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    categorical: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    tables: dict[str, tuple[str, int, str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str],
            method: str = "exact") -> "Preparer":
        # Parameter tables hold one row per feature; only they reach the driver.
        num = {r["feature"]: (r["median"], r["mean"], r["std"])
               for r in fit_numeric(df, num_cols, method).collect()} if num_cols else {}
        cat, tables = {}, {}
        if cat_cols:
            counts = stored(category_counts(df, cat_cols), "category-counts")
            many = {}
            for r in _modes(counts).collect():
                if r["categories"] is not None:
                    cat[r["feature"]] = (r["mode"], list(r["categories"]))
                else:
                    many[r["feature"]] = (r["mode"], r["n_values"])
            if many:
                places = stored(numbered(counts.where(F.col("feature").isin(*many))).select("feature", "v", "index"), "category-numbers")
                for c, (mode, n) in many.items():
                    path = shared_path(df.sparkSession, "tables", f"categories-{uuid.uuid4().hex}")
                    places.where(F.col("feature") == c).select("v", "index").write.parquet(path)
                    tables[c] = (mode, n, path)
        return cls(num, cat, tables)

    def aligned(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The training columns, null where the input lacks one."""
        have = set(df.columns)
        columns = [c for c in [*self.numeric, *self.categorical, *self.tables] if c not in keep]
        return df.select(*keep, *[F.col(c) if c in have else F.lit(None).cast("double" if c in self.numeric else "string").alias(c) for c in columns])

    def n_outputs(self) -> int:
        return len(self.numeric) + sum(len(cats) for _, cats in self.categorical.values()) + sum(n for _, n, _ in self.tables.values())

    def output_names(self) -> list[str]:
        """Of every column of the vector; a value of a table goes by its number."""
        names = [f"num__{c}" for c in self.numeric]
        for c, (_, cats) in self.categorical.items():
            names += [f"cat__{c}_{v}" for v in cats]
        for c, (_, n, _) in self.tables.items():
            names += [f"cat__{c}_#{i}" for i in range(n)]
        return names

    def expressions(self) -> list:
        out = []
        for c, (med, mean, std) in self.numeric.items():
            med = 0.0 if med is None else med
            scale = std if std not in (None, 0.0) else 1.0
            x = F.coalesce(F.col(c).cast("double"), F.lit(med))
            out.append(((x - F.lit(mean)) / F.lit(scale)).alias(f"num__{c}"))
        for c, (mode, cats) in self.categorical.items():
            v = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out += [(v == F.lit(cat)).cast("double").alias(f"cat__{c}_{cat}") for cat in cats]
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Scaled numbers and one-hot categories (unknown -> all zeros), without
        the features of ``tables``, which have vectors only."""
        return df.select(*keep, *self.expressions())

    def to_vector(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        found = []
        for i, (c, (mode, n, path)) in enumerate(self.tables.items()):
            table = df.sparkSession.read.parquet(path).select(F.col("v").alias(f"_v{i}"), F.col("index").alias(f"_index{i}"))
            df = df.withColumn(f"_c{i}", F.coalesce(F.col(c).cast("string"), F.lit(mode))).join(table, F.col(f"_c{i}") == F.col(f"_v{i}"), "left")
            df = df.withColumn(f"_n{i}", F.coalesce(f"_index{i}", F.lit(n)).cast("double")).drop(f"_c{i}", f"_v{i}", f"_index{i}")
            found.append((f"_n{i}", n))
        wide = df.select(*keep, *[c for c, _ in found], *self.expressions())
        parts = [e for e in wide.columns if e not in keep and e not in {c for c, _ in found}]
        for c, n in found:
            # the last number stands for unknown values, and its slot is left out
            last = wide.sparkSession.createDataFrame([(float(n),)], f"{c} double")
            wide = OneHotEncoder(inputCol=c, outputCol=f"{c}_v", dropLast=True).fit(last).transform(wide)
            parts.append(f"{c}_v")
        return VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(wide).select(*keep, out)
