"""Analytic views built from the driver's tables.

The reference works on bank transactions and on a customer table. Those raw
files are not part of the data we run on, so the same shapes are derived
from the given tables (definitions in FIXTURES.md). Each view is a lazy
DataFrame: a query reads the columns it uses and nothing is cached for it.
Views that a query reads several times are stored by that query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import exclusive_running_sum
from ..sources.tables import read_table

# Fixed values of the fixture mapping (FIXTURES.md section 2).
EPOCH = "2024-01-01 00:00:00"
START_BALANCE = 2500
MERCHANTS = 10

# Part type -> spending column, in this order.
SPEND_BY_PART_TYPE = [
    ("ECONOMY", "MntWines"),
    ("LARGE", "MntFruits"),
    ("MEDIUM", "MntMeatProducts"),
    ("PROMO", "MntFishProducts"),
    ("SMALL", "MntSweetProducts"),
    ("STANDARD", "MntGoldProds"),
]
# Order priority -> purchase-channel column.
CHANNEL_BY_PRIORITY = [
    (("1-URGENT",), "NumDealsPurchases"),
    (("2-HIGH",), "NumWebPurchases"),
    (("3-MEDIUM",), "NumCatalogPurchases"),
    (("4-NOT SPECIFIED", "5-LOW"), "NumStorePurchases"),
]
# Campaign i accepted = ordered with this priority in the last year.
CAMPAIGN_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


def _event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    seconds = F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return ev.select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("type"),
        F.col("value").cast("decimal(18,2)").alias("amount_dec"),
        (F.col("user_id") % MERCHANTS).alias("nameDest"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(seconds / 3600).cast("int").alias("step"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``T``: one row per event with running account balances.

    Balances are exclusive running sums per sender and per merchant, chunked
    by hour (``step``) so a hot account never lands in one task."""
    base = _event_base(spark, sf_dir)
    order = ["ts", "event_id"]
    w = exclusive_running_sum(base, ["user_id"], "step", order, "amount_dec", "pu")
    w = exclusive_running_sum(w, ["nameDest"], "step", order, "amount_dec", "pd", source=base)
    old_org = F.greatest(F.lit(0), F.lit(START_BALANCE) - F.col("pu"))
    fraud = F.col("k") == 0
    return w.select(
        "event_id", "step", "type",
        F.col("amount_dec").cast("double").alias("amount"),
        F.col("user_id").alias("nameOrig"),
        "nameDest",
        F.when(fraud, 1).otherwise(0).cast("int").alias("isFraud"),
        old_org.cast("double").alias("oldbalanceOrg"),
        F.greatest(F.lit(0), old_org - F.col("amount_dec")).cast("double").alias("newbalanceOrig"),
        F.col("pd").cast("double").alias("oldbalanceDest"),
        F.when(fraud, F.lit(0)).otherwise(F.col("pd") + F.col("amount_dec")).cast("double").alias("newbalanceDest"),
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``P``: labelled rows with a deterministic score of 100 levels
    (many ties), the input of every classification metric. Built straight
    from ``events``; it needs none of the balance windows."""
    b = _event_base(spark, sf_dir)
    amount = F.col("amount_dec").cast("double")
    level = F.floor(F.least(amount, F.lit(499.99)) / 5).cast("int")
    fraud = F.col("k") == 0
    # frauds lean to high scores and the others to low ones; both reach far into the other side
    score = F.when(fraud, 99 - F.floor((99 - level) * (99 - level) / 100)).otherwise(F.floor(level * level / 110))
    return b.select(
        "event_id", amount.alias("amount"), "type", "step",
        F.when(fraud, 1).otherwise(0).cast("int").alias("y"),
        (score / 100).alias("proba"),
    )


def narrow_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``X``: the columns of ``T`` that need no balance."""
    return _event_base(spark, sf_dir).select(
        "event_id", "step", "type", F.col("amount_dec").cast("double").alias("amount"), F.col("user_id").alias("nameOrig"), "nameDest",
        F.when(F.col("k") == 0, 1).otherwise(0).cast("int").alias("isFraud"))


def customer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``SC``: the columns of ``S`` that need the customers only."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = read_table(spark, sf_dir, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("Education"), F.col("r_name").alias("Marital_Status"),
                    F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).cast("double").alias("Income"))


def channel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``SO``: orders by channel of each customer."""
    ords = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ocust")).agg(
        *[F.count_if(F.col("o_orderpriority").isin(*ps)).alias(c) for ps, c in CHANNEL_BY_PRIORITY])
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID")).join(ords, F.col("ID") == F.col("ocust"), "left")
    return c.select("ID", *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for _, c in CHANNEL_BY_PRIORITY])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``S``: one row per customer in the reference's customer layout."""
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")

    max_date = orders.agg(F.max("o_orderdate")).scalar()
    last_year = F.col("o_orderdate") > max_date - F.expr("INTERVAL 365 DAYS")
    last_90 = F.col("o_orderdate") > max_date - F.expr("INTERVAL 90 DAYS")

    # Line level: price by part type per order, pre-aggregated per order
    # before meeting ``orders`` (fewer rows through the second shuffle).
    li = (lineitem.select("l_orderkey", "l_partkey", "l_returnflag",
                          F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
          .join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))
    per_order = li.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == t, F.col("price")).otherwise(F.lit(0))).alias(c)
          for t, c in SPEND_BY_PART_TYPE],
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        F.count(F.lit(1)).alias("lines"),
    )
    spend = (per_order.join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"),
                            F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy(F.col("o_custkey").alias("custkey"))
             .agg(*[F.sum(c).alias(c) for _, c in SPEND_BY_PART_TYPE],
                  F.max("returned").alias("Complain"),
                  F.sum(F.when(F.col("o_orderstatus") == "O", F.col("lines")).otherwise(F.lit(0)))
                  .alias("NumWebVisitsMonth")))

    ord_aggs = [F.count_if(F.col("o_orderpriority").isin(*ps)).cast("int").alias(c)
                for ps, c in CHANNEL_BY_PRIORITY]
    ord_aggs += [F.max(F.when(last_year & (F.col("o_orderpriority") == p), 1).otherwise(0))
                 .cast("int").alias(f"AcceptedCmp{i}")
                 for i, p in enumerate(CAMPAIGN_PRIORITIES, start=1)]
    ord_aggs += [F.max(F.when(last_90, 1).otherwise(0)).cast("int").alias("Response"),
                 F.max("o_orderdate").alias("last_order"),
                 F.min("o_orderdate").alias("first_order")]
    ords = orders.groupBy(F.col("o_custkey").alias("ocust")).agg(*ord_aggs)

    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = (customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(spend, F.col("c_custkey") == F.col("custkey"), "left")
         .join(ords, F.col("c_custkey") == F.col("ocust"), "left"))
    key = F.col("c_custkey")
    return c.select(
        key.alias("ID"),
        (F.lit(1940) + key % 60).cast("int").alias("Year_Birth"),
        F.col("c_mktsegment").alias("Education"),
        F.col("r_name").alias("Marital_Status"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).cast("double").alias("Income"),
        (key % 3).cast("int").alias("Kidhome"),
        (key % 2).cast("int").alias("Teenhome"),
        F.date_format("first_order", "dd/MM/yyyy").alias("Dt_Customer"),
        F.datediff(F.to_date(F.lit(max_date)), F.to_date("last_order")).cast("int").alias("Recency"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for _, c in SPEND_BY_PART_TYPE],
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for _, c in CHANNEL_BY_PRIORITY],
        F.coalesce(F.col("NumWebVisitsMonth"), F.lit(0)).cast("int").alias("NumWebVisitsMonth"),
        *[F.coalesce(F.col(f"AcceptedCmp{i}"), F.lit(0)).cast("int").alias(f"AcceptedCmp{i}")
          for i in range(1, 6)],
        F.coalesce(F.col("Response"), F.lit(0)).cast("int").alias("Response"),
        F.coalesce(F.col("Complain"), F.lit(0)).cast("int").alias("Complain"),
        F.lit(3).cast("int").alias("Z_CostContact"),
        F.lit(11).cast("int").alias("Z_Revenue"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``V``: id, feature array (double) and a given cluster label."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                      F.col("label").cast("int").alias("cluster"))


BUILDERS = {
    "T": transactions,
    "X": narrow_transactions,
    "SC": customer_columns,
    "SO": channel_columns,
    "P": scored_rows,
    "S": customers,
    "V": vectors,
}
