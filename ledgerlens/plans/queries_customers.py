"""Customer-side queries (view S): cleaning, features, profiles, segment
tables and model-input preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as B
from ..operators import features as C
from ..operators import prep as G
from ..operators import stats as D
from ..session import stored
from ..plans.views import CHANNEL_BY_PRIORITY, SPEND_BY_PART_TYPE
from .catalog import SC, SO, S, r6, register

MNT = [c for _, c in SPEND_BY_PART_TYPE]
NUM = [c for _, c in CHANNEL_BY_PRIORITY]


def prepared_customers(spark, sf):
    """B3 then C7-C13 (the reference's customer preparation)."""
    s = stored(S(spark, sf), "customers")  # read for the median, the last date and the rows
    return C.build_cluster_features(B.preprocess_cluster(s, unique="ID"))


_PREP_SQL = """
sp AS (SELECT * EXCLUDE (Z_CostContact, Z_Revenue)
              REPLACE (coalesce(Income, (SELECT median(Income) FROM (SELECT DISTINCT * FROM s))) AS Income)
       FROM (SELECT DISTINCT * FROM s))"""

_FEAT_SQL = _PREP_SQL + """,
sf_ AS (SELECT *, try_strptime(Dt_Customer, '%d/%m/%Y')::DATE dt FROM sp),
sf2 AS (SELECT * EXCLUDE (dt), CAST(2026 - Year_Birth AS INT) Age,
       CAST(date_diff('day', dt, (SELECT max(dt) FROM sf_)) AS INT) Customer_Tenure_days,
       {spend} Total_Spending, {purch} Total_Purchases,
       {ratios},
       Kidhome + Teenhome Children,
       {camp} Campaign_Acceptance_Total
FROM sf_)""".format(
    spend=" + ".join(f"coalesce({c}, 0)" for c in MNT),
    purch=" + ".join(f"coalesce({c}, 0)" for c in NUM),
    ratios=", ".join(
        f"{c} / nullif(CAST({' + '.join(f'coalesce({x}, 0)' for x in NUM)} AS DOUBLE), 0) "
        f"{c.replace('Num', '').replace('Purchases', '_Ratio')}" for c in NUM),
    camp=" + ".join(f"coalesce({c}, 0)" for c in [f"AcceptedCmp{i}" for i in range(1, 6)] + ["Response"]))


@register("customers_view", "SELECT * FROM s", ("s",))
def q_customers_view(spark, sf):
    return S(spark, sf)


@register("preprocess_customers", "WITH " + _PREP_SQL + " SELECT * FROM sp", ("s",))
def q_preprocess_customers(spark, sf):
    """Duplicates removed, Income nulls -> exact median, constants dropped."""
    return B.preprocess_cluster(S(spark, sf))


def _const_sql():
    cols = ["ID", "Year_Birth", "Education", "Marital_Status", "Income", "Kidhome", "Teenhome", "Dt_Customer",
            "Recency", *MNT, *NUM, "NumWebVisitsMonth", *[f"AcceptedCmp{i}" for i in range(1, 6)], "Response",
            "Complain", "Z_CostContact", "Z_Revenue"]
    aggs = ", ".join(f'count(DISTINCT "{c}") + max(CAST("{c}" IS NULL AS BIGINT)) "{c}"' for c in cols)
    on = ", ".join(f'"{c}"' for c in cols)
    return f"""SELECT "column" FROM (UNPIVOT (SELECT {aggs} FROM s) ON {on} INTO NAME "column" VALUE d) WHERE d = 1"""


@register("constant_columns", _const_sql(), ("s",))
def q_constant_columns(spark, sf):
    """Columns holding a single value."""
    return B.constant_columns(S(spark, sf))


@register("customer_features", "WITH " + _FEAT_SQL + " SELECT * FROM sf2", ("s",))
def q_customer_features(spark, sf):
    """C7-C13 on the cleaned customers."""
    return prepared_customers(spark, sf)


_DESC_COLS = ["Income", "Recency", "Year_Birth", "MntWines", "MntMeatProducts", "NumWebPurchases",
              "NumStorePurchases"]


@register("describe_customers", """
WITH l AS (UNPIVOT (SELECT {sel} FROM s) ON {on} INTO NAME "column" VALUE v)
SELECT "column", count(v) "count", round(avg(v), 6) mean, round(stddev_samp(v), 6) std, min(v) "min", max(v) "max",
       round(quantile_cont(v, 0.25), 6) q25, round(quantile_cont(v, 0.5), 6) q50, round(quantile_cont(v, 0.75), 6) q75
FROM l GROUP BY 1""".format(sel=", ".join(f"CAST({c} AS DOUBLE) {c}" for c in _DESC_COLS),
                            on=", ".join(_DESC_COLS)), ("s",))
def q_describe_customers(spark, sf):
    """Count, mean, std, min, quartiles, max of customer columns."""
    d = D.describe(S(spark, sf), _DESC_COLS)
    return d.select("column", "count", "min", "max", *[r6(c).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@register("top_education", """
SELECT Education, count(*) "count" FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", ("s",))
def q_top_education(spark, sf):
    """Most frequent values."""
    return D.top_values(SC(spark, sf), "Education", 10)


@register("spending_summary", """
SELECT categorie, round(depense_moyenne, 6) depense_moyenne FROM (
  UNPIVOT (SELECT {a} FROM s) ON {c} INTO NAME categorie VALUE depense_moyenne)""".format(
    a=", ".join(f"avg({c}) {c}" for c in MNT), c=", ".join(MNT)), ("s",))
def q_spending_summary(spark, sf):
    """Mean spend per category, long, largest first."""
    return D.column_means(S(spark, sf), MNT, "categorie", "depense_moyenne").withColumn(
        "depense_moyenne", r6("depense_moyenne"))


_CHANNELS = ["NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases", "NumDealsPurchases"]


@register("channel_summary", """
SELECT canal, round(achats_moyens, 6) achats_moyens FROM (
  UNPIVOT (SELECT {a} FROM s) ON {c} INTO NAME canal VALUE achats_moyens)""".format(
    a=", ".join(f"avg({c}) {c}" for c in _CHANNELS), c=", ".join(_CHANNELS)), ("s",))
def q_channel_summary(spark, sf):
    """Mean purchases per channel."""
    return D.column_means(SO(spark, sf), _CHANNELS, "canal", "achats_moyens").withColumn(
        "achats_moyens", r6("achats_moyens"))


def engagement_segments(spark, sf):
    """Prepared customers with a rule-based segment (campaign engagement,
    capped at 3) standing in for a fitted cluster id."""
    c = prepared_customers(spark, sf)
    return c.withColumn("cluster", F.least(F.col("Campaign_Acceptance_Total"), F.lit(3)).cast("int"))


def _mean_2dp_sql(c):
    """As ``stats.mean_2dp``: exact, halves away from zero."""
    u = f"CAST(sum(CAST({c} AS DECIMAL(28,6))) * 1000000 AS HUGEINT)"
    return f"CAST(sign({u}) * CAST((abs({u}) * 2 + count({c}) * 10000) // (count({c}) * 20000) AS DOUBLE) / 100 AS DOUBLE)"


_SEG_SQL = _FEAT_SQL + """,
seg AS (SELECT *, CAST(least(Campaign_Acceptance_Total, 3) AS INT) cluster FROM sf2),
prof AS (SELECT cluster, {means}, count(*) cluster_size FROM seg GROUP BY cluster)""".format(
    means=", ".join(f"{_mean_2dp_sql(c)} {c}" for c in D.PROFILE_COLUMNS))


@register("cluster_profiles", "WITH " + _SEG_SQL + " SELECT * FROM prof", ("s",))
def q_cluster_profiles(spark, sf):
    """Per-segment means (2 decimals) and sizes."""
    return D.profile_clusters(engagement_segments(spark, sf))


_HEAT = ["Income", "Recency", "Total_Spending", "Total_Purchases", "NumWebPurchases", "NumStorePurchases",
         "NumCatalogPurchases", "NumDealsPurchases", "Campaign_Acceptance_Total"]


@register("profile_heatmap", "WITH " + _SEG_SQL + """
SELECT cluster, {n} FROM prof""".format(n=", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9), 6) {c}" for c in _HEAT)),
    ("s",))
def q_profile_heatmap(spark, sf):
    """Profiles min-max normalised per column."""
    prof = D.profile_clusters(engagement_segments(spark, sf)).select("cluster", *_HEAT)
    n = D.minmax_normalise(prof, _HEAT)
    return n.select("cluster", *[r6(c).alias(c) for c in _HEAT])


@register("segment_shares", "WITH " + _SEG_SQL + """
SELECT cluster, cluster_size, round(cluster_size / sum(cluster_size) OVER (), 6) share,
       cluster = (SELECT cluster FROM prof ORDER BY Total_Spending DESC, cluster LIMIT 1) is_premium,
       coalesce(n.segment, 'Segment non nommé') segment
FROM prof LEFT JOIN (VALUES (0, 'Dormants à faible valeur'), (1, 'Chasseurs de promotions digitaux'),
                            (2, 'Premium ultra-engagés'), (3, 'Fidèles à forte valeur')) n(c, segment)
     ON prof.cluster = n.c""", ("s",))
def q_segment_shares(spark, sf):
    """D19 + B12: share of customers per segment, premium segment (highest
    mean spend) and segment names."""
    prof = D.profile_clusters(engagement_segments(spark, sf))
    sh = D.segment_shares(prof).select("cluster", "cluster_size", r6("share").alias("share"), "is_premium")
    return B.attach_segments(sh).drop("action")


@register("customer_kpis", "WITH " + _FEAT_SQL + """
SELECT count(*) customers, round(median(Income), 6) median_income, round(median(Total_Spending), 6) median_spending,
       round(median(Total_Purchases), 6) median_purchases FROM sf2""", ("s",))
def q_customer_kpis(spark, sf):
    """Customer count and medians."""
    k = D.customer_kpis(prepared_customers(spark, sf))
    return k.select("customers", *[r6(c).alias(c) for c in ("median_income", "median_spending", "median_purchases")])


@register("income_histogram", """
WITH b AS (SELECT min(Income) lo, max(Income) hi FROM s)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((Income - lo) / ((hi - lo) / 45)), 44) END AS INT) bin,
       count(*) "count", round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 45), 6) bin_start,
       round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 45), 6) bin_end
FROM s, b WHERE Income IS NOT NULL GROUP BY 1""", ("s",))
def q_income_histogram(spark, sf):
    """45 equal-width Income bins."""
    h = D.histogram(SC(spark, sf), "Income", 45)
    return h.withColumn("bin_start", r6("bin_start")).withColumn("bin_end", r6("bin_end"))


_PREP_NUM = ["Income", "Recency", "Age", "Total_Spending", "Total_Purchases", "Children", "Deals_Ratio",
             "Web_Ratio", "Customer_Tenure_days"]
_PREP_CAT = ["Education", "Marital_Status"]


@register("scaler_params", "WITH " + _FEAT_SQL + """,
l AS (UNPIVOT (SELECT {c} FROM sf2) ON {n} INTO NAME feature VALUE x),
m AS (SELECT feature, median(x) median FROM l GROUP BY 1)
SELECT feature, round(median, 6) median, round(avg(coalesce(x, median)), 6) mean,
       round(stddev_pop(coalesce(x, median)), 6) std
FROM l JOIN m USING (feature) GROUP BY feature, median""".format(
    c=", ".join(f"CAST({c} AS DOUBLE) {c}" for c in _PREP_NUM), n=", ".join(_PREP_NUM)), ("s",))
def q_scaler_params(spark, sf):
    """G1: exact median, mean and population std of the imputed features."""
    p = G.fit_numeric(prepared_customers(spark, sf), _PREP_NUM)
    return p.select("feature", *[r6(c).alias(c) for c in ("median", "mean", "std")])


@register("category_params", """
WITH l AS (UNPIVOT (SELECT Education, Marital_Status FROM s) ON Education, Marital_Status
           INTO NAME feature VALUE v),
c AS (SELECT feature, v, count(*) n FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT feature, arg_min(v, (-n, v)) "mode", list_sort(list(v)) categories FROM c GROUP BY feature""", ("s",))
def q_category_params(spark, sf):
    """Most frequent value and sorted category list per categorical feature."""
    return G.fit_categorical(SC(spark, sf), _PREP_CAT)
