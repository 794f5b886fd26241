"""Cleaning, projection and filtering (inventory B1-B15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import grouped_quantiles

FRAUD_ID_COLUMNS = ("nameOrig", "nameDest", "isFlaggedFraud")
CLUSTER_DROP_COLUMNS = ("ID", "Response", "Complain", "Dt_Customer")
CONSTANT_COLUMNS = ("Z_CostContact", "Z_Revenue")


def basic_cleaning(df: DataFrame, unique: str | None = None) -> DataFrame:
    """B1: trim column names, drop exact duplicate rows. No row can repeat
    in a frame that holds a ``unique`` id; it is not shuffled.

    ``dropDuplicates()`` plans as a grouped aggregate over all columns with a
    map-side partial step, so a heavily repeated row collapses before the
    shuffle."""
    renamed = df.toDF(*[c.strip() for c in df.columns])
    return renamed if unique is not None and unique in renamed.columns else renamed.dropDuplicates()


def preprocess_fraud(df: DataFrame, unique: str | None = None) -> DataFrame:
    """B2: B1, then an origin balance of 0 becomes missing."""
    out = basic_cleaning(df, unique)
    if "oldbalanceOrg" in out.columns:
        out = out.withColumn("oldbalanceOrg", F.nullif(F.col("oldbalanceOrg"), F.lit(0).cast("double")))
    return out


def preprocess_cluster(df: DataFrame, income_median: float | Column | None = None,
                       method: str = "exact", unique: str | None = None) -> DataFrame:
    """B1, missing ``Income`` -> the global median, constant columns dropped.

    The median is found by distributed selection (``grouped_quantiles``) and
    enters the plan as a one-row result; pass ``income_median`` to reuse the
    training value when scoring new rows."""
    out = basic_cleaning(df, unique)
    if "Income" in out.columns:
        if income_median is None:
            med = grouped_quantiles(out, {"_inc_med": ("Income", 0.5)}, method=method)
            income_median = med.scalar()
        fill = income_median if isinstance(income_median, Column) else F.lit(float(income_median))
        out = out.withColumn("Income", F.coalesce(F.col("Income"), fill))
    return out.drop(*[c for c in CONSTANT_COLUMNS if c in out.columns])


def balance_inconsistency(df: DataFrame) -> DataFrame:
    """Share of rows whose balances do not add up. A missing side counts
    as inconsistent (``NaN != x`` is true in pandas)."""
    org = ~(F.col("oldbalanceOrg") - F.col("amount")).eqNullSafe(F.col("newbalanceOrig"))
    dst = ~(F.col("oldbalanceDest") + F.col("amount")).eqNullSafe(F.col("newbalanceDest"))
    return df.agg(F.avg(org.cast("double")).alias("origin_inconsistency"),
                  F.avg(dst.cast("double")).alias("dest_inconsistency"))


def drop_feature_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop id / target / leak columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def align_to_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reindex to the training columns; absent ones null, extras gone."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def missing_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """Null count per column, largest first, top ``top``.

    One pass computes every count; ``unpivot`` turns the single row into
    (column, missing) rows."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "missing")
    return long.orderBy(F.desc("missing"), F.asc("column")).limit(top)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (null-safe: group by all columns)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct value, null counted as a value."""
    n, present = F.count(F.lit(1)), lambda c: F.count(F.col(c))
    # all rows null, or no null and min = max: one pass, no row per column
    constant = lambda c: (n > 0) & ((present(c) == 0) | ((present(c) == n) & (F.min(F.col(c)) == F.max(F.col(c)))))
    one = df.agg(*[constant(c).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "is_constant").where("is_constant").select("column")


def label_class(df: DataFrame, target: str = "isFraud", out: str = "label") -> DataFrame:
    """0/1 target -> readable class name."""
    return df.withColumn(out, F.when(F.col(target).cast("int") == 1, F.lit("Fraude")).otherwise(F.lit("Normal")))


# Segment names and actions by cluster id, with their defaults.
SEGMENT_NAMES = {
    0: "Dormants à faible valeur",
    1: "Chasseurs de promotions digitaux",
    2: "Premium ultra-engagés",
    3: "Fidèles à forte valeur",
}
SEGMENT_ACTIONS = {
    0: "Réactivation, offres accessibles, parcours d'onboarding.",
    1: "Coupons, retargeting web, bundles promotionnels.",
    2: "Programme VIP, avant-premières, offres premium.",
    3: "Fidélisation, cross-sell, expérience omnicanale.",
}
SEGMENT_DEFAULT_NAME = "Segment non nommé"
SEGMENT_DEFAULT_ACTION = "Analyse complémentaire."


def segment_dimension(spark) -> DataFrame:
    rows = [(k, SEGMENT_NAMES[k], SEGMENT_ACTIONS[k]) for k in sorted(SEGMENT_NAMES)]
    return spark.createDataFrame(rows, "cluster int, segment string, action string")


def attach_segments(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Name / action per cluster id, default for unknown ids.

    The dimension has four literal rows, so the broadcast is size-bounded."""
    dim = segment_dimension(df.sparkSession).withColumnRenamed("cluster", "_seg_cluster")
    j = df.join(F.broadcast(dim), F.col(cluster) == F.col("_seg_cluster"), "left")
    return (j.withColumn("segment", F.coalesce("segment", F.lit(SEGMENT_DEFAULT_NAME)))
            .withColumn("action", F.coalesce("action", F.lit(SEGMENT_DEFAULT_ACTION)))
            .drop("_seg_cluster"))


def prettify_feature(c: str | Column) -> Column:
    """Encoded feature name -> display name."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.replace(F.replace(c, F.lit("num__"), F.lit("")), F.lit("cat__"), F.lit(""))
    return F.replace(out, F.lit("type_"), F.lit("type="))


def parse_model_key(c: str | Column) -> tuple[Column, Column]:
    """``kmeans_k4`` -> ("kmeans", 4)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.regexp_extract(c, r"^(\w+?)_k\d+$", 1),
            F.regexp_extract(c, r"_k(\d+)", 1).cast("int"))


def frame_profile(df: DataFrame) -> DataFrame:
    """Row count and column types in one small table."""
    n = df.agg(F.count(F.lit(1))).scalar()
    types = df.sparkSession.createDataFrame(
        [(i, name, t) for i, (name, t) in enumerate(df.dtypes)], "position int, column string, dtype string")
    return types.withColumn("rows", n).withColumn("columns", F.lit(len(df.columns)))


# Display names of features, and the display of unknown ones stays the name.
FEATURE_LABELS = {
    "step": "Step",
    "amount": "Amount",
    "oldbalanceOrg": "Origin balance before",
    "newbalanceOrig": "Origin balance after",
    "oldbalanceDest": "Destination balance before",
    "newbalanceDest": "Destination balance after",
    "origin_error": "Origin balance error",
    "dest_error": "Destination balance error",
    "amount_to_oldbalance_ratio": "Amount to balance ratio",
}


def label_feature(c: str | Column, labels: Mapping[str, str] = FEATURE_LABELS) -> Column:
    """Display name, replaced by its label where there is one."""
    name = prettify_feature(c)
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)
