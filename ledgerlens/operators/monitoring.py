"""Monitoring and campaign readout (inventory I1-I10).

Drift, gates and readouts are grouped aggregates and equi-joins. The one
"next event of the same customer" lookup (30-day repurchase) uses a chunked
lead (window per (key, month) plus a small per-chunk table), so a customer
with a third of all orders never lands in one task, and no self-join emits
order pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import grouped_quantiles
from .sampling import row_hash

PSI_EPS = 1e-6
DECILES = [i / 10 for i in range(1, 10)]


def metric_gates(values: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    """``values`` is (check, value); one row per check with its minimum
    and whether it passes."""
    spark = values.sparkSession
    mins = spark.createDataFrame([(k, float(v)) for k, v in minimums.items()], "check string, minimum double")
    return (mins.join(values, "check", "left")
            .withColumn("passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))))


def threshold_consistency(tables: Mapping[str, DataFrame], reference: str, tol: float = 0.001) -> DataFrame:
    """Each table holds one ``threshold``; every one must equal the
    reference table's within ``tol``. One row per compared table."""
    ref = tables[reference].select(F.col("threshold").alias("ref_threshold"))
    rows = None
    for name, t in tables.items():
        if name == reference:
            continue
        r = t.select(F.lit(name).alias("output"), "threshold")
        rows = r if rows is None else rows.unionByName(r)
    return (rows.withColumn("ref_threshold", ref.scalar())
            .withColumn("consistent", F.abs(F.col("threshold") - F.col("ref_threshold")) <= tol))


def missing_artifacts(spark, folder: str, required: Sequence[str]) -> DataFrame:
    """Required names that are absent from ``folder`` (left anti join of
    the expected names against the folder's listing). An absent folder lacks
    them all; any other error is raised."""
    want = spark.createDataFrame([(r,) for r in required], "name string")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(f.getPath().getName(),) for f in store.listStatus(path)] if store.exists(path) else []
    return want.join(spark.createDataFrame(names, "name string"), "name", "left_anti")


def psi_numeric(ref: DataFrame, cur: DataFrame, columns: str | Sequence[str], probs: Sequence[float] = DECILES,
                eps: float = PSI_EPS) -> DataFrame:
    """I4 (numeric): bins cut at the reference deciles (exact), shares per bin
    in both windows and ``sum((q - p) * ln(q / p))`` with ``eps`` for empty
    bins. All columns go together: one selection of the cuts, one grouped
    count of (feature, bin) over both windows."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    spec = {f"{c}|{i}": (c, p) for c in columns for i, p in enumerate(probs)}
    # a row of cut points: features x 9 numbers
    q = grouped_quantiles(ref, spec).first()
    both = ref.select(F.lit(True).alias("_ref"), *columns).unionByName(cur.select(F.lit(False).alias("_ref"), *columns))

    def slot(c: str) -> Column:
        cuts = [q[f"{c}|{i}"] for i in range(len(probs))]
        below = [(F.lit(x) < F.col(c).cast("double")).cast("int") for x in cuts if x is not None]
        return F.when(F.col(c).isNotNull(), sum(below, F.lit(0)))

    long = both.select("_ref", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), slot(c).cast("string").alias("bin")) for c in columns])).alias("s"))
    return _psi(long.select("_ref", "s.feature", "s.bin").where(F.col("bin").isNotNull()), eps)


def psi_categorical(ref: DataFrame, cur: DataFrame, column: str, eps: float = PSI_EPS) -> DataFrame:
    """I4 (categorical): one bin per category."""
    one = lambda df, is_ref: df.select(F.lit(is_ref).alias("_ref"), F.lit(column).alias("feature"), F.col(column).cast("string").alias("bin"))
    return _psi(one(ref, True).unionByName(one(cur, False)), eps)


def _psi(bins: DataFrame, eps: float) -> DataFrame:
    """(feature, psi, alert) from one row per value: _ref, feature, bin."""
    counts = bins.groupBy("feature", "bin").agg(F.count_if("_ref").alias("np"), F.count_if(~F.col("_ref")).alias("nq"))
    w = Window.partitionBy("feature")  # over the counted bins only
    share = lambda c: F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)), F.lit(eps))
    return (counts.select("feature", share("np").alias("p"), share("nq").alias("q"))
            .groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))
            .withColumn("alert", F.col("psi") > 0.2))


def relative_drift(ref: DataFrame, cur: DataFrame, metrics: Mapping[str, tuple[str, Column | None]],
                   limit: float = 0.20) -> DataFrame:
    """Named scalar metrics on both windows, relative change and alert.
    ``metrics`` maps name -> ("rate", condition) or ("median", column)."""
    out = None
    for name, (kind, arg) in metrics.items():
        if kind == "rate":
            a = ref.agg(F.avg(arg.cast("double"))).scalar()
            b = cur.agg(F.avg(arg.cast("double"))).scalar()
        elif kind == "median":
            a = grouped_quantiles(ref, {"m": (arg, 0.5)}).scalar()
            b = grouped_quantiles(cur, {"m": (arg, 0.5)}).scalar()
        else:
            raise ValueError(kind)
        row = ref.sparkSession.range(1).select(F.lit(name).alias("metric"), a.alias("reference"), b.alias("current"))
        out = row if out is None else out.unionByName(row)
    rel = F.try_divide(F.col("current") - F.col("reference"), F.abs(F.col("reference")))
    return out.withColumn("relative_change", rel).withColumn("alert", F.abs(rel) > limit)


def alerts_per_day(df: DataFrame, day: Column, alert: Column, capacity: int) -> DataFrame:
    """I6 (batch): alerts per day against the review capacity."""
    return (df.groupBy(day.alias("day")).agg(F.count_if(alert).alias("alerts"), F.count(F.lit(1)).alias("rows"))
            .withColumn("over_capacity", F.col("alerts") > capacity))


def small_clusters(shares: DataFrame, minimum: float = 0.02) -> DataFrame:
    """Segments under ``minimum`` of the base."""
    return shares.withColumn("too_small", F.col("share") < minimum)


def dominant_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key (smallest on ties): two grouped
    aggregates, no window."""
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def migration(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """I8: (old, new, count) matrix over keys present in both, and the share
    of keys whose segment changed with an alert above 20 %."""
    j = old.join(new, key)
    matrix = j.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
    rate = j.agg(F.avg((F.col("old") != F.col("new")).cast("double")).alias("migration_rate"),
                 F.count(F.lit(1)).alias("keys")).withColumn("alert", F.col("migration_rate") > 0.2)
    return matrix, rate


def next_event_gap(df: DataFrame, key: str, ts: str, chunk: Column, order_key: str) -> DataFrame:
    """Adds ``_next_ts``: the time of the same key's next event (by ``ts``,
    then ``order_key``). A window per (key, chunk) finds the next event
    inside the chunk; the first event of the next non-empty chunk comes from
    a small per-(key, chunk) table."""
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(key, "_chunk").orderBy(ts, order_key)
    local = d.withColumn("_lead", F.lead(ts).over(w))
    firsts = d.groupBy(key, "_chunk").agg(F.min(ts).alias("_first"))
    wf = Window.partitionBy(key).orderBy("_chunk")
    nxt = firsts.select(key, "_chunk", F.lead("_first").over(wf).alias("_next_chunk_first"))
    return (local.join(nxt, [key, "_chunk"])
            .withColumn("_next_ts", F.coalesce("_lead", "_next_chunk_first"))
            .drop("_lead", "_next_chunk_first", "_chunk"))


def ab_readout(customers: DataFrame, orders: DataFrame, window_start: Column, seed: int = 42) -> DataFrame:
    """Customers split A (control) / B (treatment) by a hash of the id;
    per group: customers, conversion in the campaign window, mean basket in
    the window, and the 30-day repurchase rate of orders."""
    grp = customers.select(F.col("c_custkey").alias("cust"),
                           F.when(row_hash("c_custkey", seed) % 2 == 0, "B").otherwise("A").alias("grp"))
    o = orders.select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_orderdate", "o_totalprice")
    o = next_event_gap(o, "cust", "o_orderdate", F.date_trunc("month", "o_orderdate"), "o_orderkey")
    in_win = F.col("o_orderdate") > window_start
    rep = (F.col("_next_ts").isNotNull()
           & (F.col("_next_ts") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    per_cust = o.groupBy("cust").agg(F.max(in_win.cast("int")).alias("converted"),
                                     F.sum(F.when(in_win, F.col("o_totalprice").cast("decimal(18,2)"))).alias("win_sum"),
                                     F.count_if(in_win).alias("win_n"),
                                     F.count_if(rep).alias("rep_n"), F.count(F.lit(1)).alias("orders"))
    j = grp.join(per_cust, "cust", "left")
    return j.groupBy("grp").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.coalesce("converted", F.lit(0)).cast("double")).alias("conversion"),
        (F.sum("win_sum") / F.sum("win_n")).cast("double").alias("basket"),
        (F.sum("rep_n") / F.sum("orders")).alias("repurchase_30d"))


def weekly_quality(scored: DataFrame, week: Column, threshold: float, baseline_pr_auc: Column | float,
                   score: str = "proba", label: str = "y", drop: float = 0.05, min_recall: float = 0.90,
                   min_precision: float = 0.95) -> DataFrame:
    """Per week recall and precision at the threshold and PR-AUC, with
    alerts when PR-AUC falls more than 5 % under the baseline, recall under
    90 % or precision under 95 %."""
    from .binary_metrics import ranking_metrics
    d = scored.withColumn("week", week)
    y = F.col(label).cast("int")
    pred = F.col(score) >= threshold
    conf = d.groupBy("week").agg(F.count_if((y == 1) & pred).alias("tp"), F.count_if((y != 1) & pred).alias("fp"),
                                 F.count_if((y == 1) & ~pred).alias("fn"))
    rk = ranking_metrics(d, score, label, by=["week"])
    base = baseline_pr_auc if isinstance(baseline_pr_auc, Column) else F.lit(float(baseline_pr_auc))
    return (conf.join(rk, "week")
            .select("week",
                    F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double")),
                               F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double")),
                               F.lit(0.0)).alias("precision"),
                    "pr_auc")
            .withColumn("pr_auc_alert", F.col("pr_auc") < base * (1 - drop))
            .withColumn("recall_alert", F.col("recall") < min_recall)
            .withColumn("precision_alert", F.col("precision") < min_precision))
