"""Derived features (inventory C1-C15). Every feature is one column
expression; each is added only when its inputs exist, like the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, floor_div, null_safe_sum, safe_ratio

SPENDING_COLUMNS = ["MntWines", "MntFruits", "MntMeatProducts", "MntFishProducts",
                    "MntSweetProducts", "MntGoldProds"]
PURCHASE_COLUMNS = ["NumDealsPurchases", "NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases"]
CAMPAIGN_COLUMNS = [f"AcceptedCmp{i}" for i in range(1, 6)]
RISK_TYPES = ("TRANSFER", "CASH_OUT")
REFERENCE_YEAR = 2026


def _has(df: DataFrame, *cols: str) -> bool:
    return set(cols).issubset(df.columns)


def build_fraud_features(df: DataFrame, risk_types=RISK_TYPES) -> DataFrame:
    """C1-C6."""
    new: dict[str, Column] = {}
    if _has(df, "oldbalanceOrg", "newbalanceOrig", "amount"):
        diff = F.col("oldbalanceOrg") - F.col("newbalanceOrig")
        new["origin_balance_diff"] = diff
        new["origin_error"] = diff - F.col("amount")
    if _has(df, "oldbalanceDest", "newbalanceDest", "amount"):
        diff = F.col("newbalanceDest") - F.col("oldbalanceDest")
        new["dest_balance_diff"] = diff
        new["dest_error"] = diff - F.col("amount")
    if _has(df, "type"):
        new["is_transfer_or_cashout"] = flag(F.col("type").isin(*risk_types))
    if _has(df, "newbalanceOrig"):
        new["is_zero_newbalance_origin"] = flag(F.col("newbalanceOrig") == 0)
    if _has(df, "oldbalanceDest"):
        new["is_zero_oldbalance_dest"] = flag(F.col("oldbalanceDest") == 0)
    if _has(df, "amount", "oldbalanceOrg"):
        new["amount_to_oldbalance_ratio"] = safe_ratio("amount", "oldbalanceOrg")
    if _has(df, "step"):
        new["step_bucket"] = floor_div("step", 24)
    return df.withColumns(new) if new else df


def add_amount_transforms(df: DataFrame) -> DataFrame:
    """Log amounts and absolute balance errors."""
    new: dict[str, Column] = {}
    if _has(df, "amount"):
        new["amount_log10"] = F.log10(F.greatest(F.col("amount"), F.lit(1.0)))
        new["amount_log1p"] = F.log1p("amount")
    for c in ("origin_error", "dest_error"):
        if _has(df, c):
            new[f"abs_{c}"] = F.abs(c)
    return df.withColumns(new) if new else df


def build_cluster_features(df: DataFrame, reference_year: int = REFERENCE_YEAR,
                           reference_date: Column | None = None) -> DataFrame:
    """C7-C13.

    ``Customer_Tenure_days`` counts days back from the latest customer date.
    That maximum is one global aggregate which enters the plan as a scalar
    subquery (no single-partition window); pass ``reference_date`` to reuse
    the training value when scoring."""
    new: dict[str, Column] = {}
    if _has(df, "Year_Birth"):
        new["Age"] = F.lit(reference_year) - F.col("Year_Birth")
    if _has(df, "Dt_Customer"):
        dt = F.try_to_timestamp(F.col("Dt_Customer"), F.lit("dd/MM/yyyy")).cast("date")
        ref = reference_date if reference_date is not None else (
            df.agg(F.max(F.try_to_timestamp(F.col("Dt_Customer"), F.lit("dd/MM/yyyy")).cast("date"))).scalar())
        # All dates unparseable -> max is null -> tenure null (reference skips the column).
        new["Customer_Tenure_days"] = F.datediff(ref, dt)
    spend = [c for c in SPENDING_COLUMNS if c in df.columns]
    if spend:
        new["Total_Spending"] = null_safe_sum(spend)
    purchases = [c for c in PURCHASE_COLUMNS if c in df.columns]
    if purchases:
        total = null_safe_sum(purchases)
        new["Total_Purchases"] = total
        for c in purchases:
            name = c.replace("Num", "").replace("Purchases", "_Ratio")
            new[name] = safe_ratio(F.col(c), total)
    if _has(df, "Kidhome", "Teenhome"):
        new["Children"] = F.col("Kidhome") + F.col("Teenhome")
    campaigns = [c for c in CAMPAIGN_COLUMNS if c in df.columns]
    if "Response" in df.columns:
        campaigns.append("Response")
    if campaigns:
        new["Campaign_Acceptance_Total"] = null_safe_sum(campaigns)
    return df.withColumns(new) if new else df
