"""Supplier summary by mergeable partial aggregates.

The same partial columns serve a batch ``groupBy``, whose map side Spark combines before the
shuffle, and the incremental job, which stores partials per batch and merges them later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.text import normalize_key
from ledgerscope.operators.history import MONEY, money

_COUNTS = ("invoices", "accepted", "observed", "rejected", "pending", "amount_count")


def clean_history(df: DataFrame, raw_key: str = "raw_key") -> DataFrame:
    """Normalized key, a state for every row, amount and issue time of the right type."""
    S.require_columns(df, (raw_key, "state", "amount", "issued_ts"), "history cleaning")
    return df.withColumns(
        {
            "supplier_key": normalize_key(F.col(raw_key)),
            "state": F.coalesce("state", F.lit(S.NO_STATE)),
            "amount": F.col("amount").try_cast("double"),
            "issued_ts": F.col("issued_ts").try_cast("timestamp"),
        }
    )


def partial_summary(df: DataFrame) -> DataFrame:
    """Partials per supplier; rows without a key are left out."""
    state = F.col("state")
    return (
        df.where(F.col("supplier_key").isNotNull())
        .groupBy("supplier_key")
        .agg(
            F.count(F.lit(1)).alias("invoices"),
            F.count_if(state == S.ACCEPTED).alias("accepted"),
            F.count_if(state == S.OBSERVED).alias("observed"),
            F.count_if(state == S.REJECTED).alias("rejected"),
            F.count_if(state.isin(*S.PENDING_STATES)).alias("pending"),
            F.coalesce(F.try_sum(money(F.col("amount"))), F.lit(0).cast(MONEY)).alias("amount_sum"),
            F.count(money(F.col("amount"))).alias("amount_count"),
            F.min("issued_ts").alias("first_issued"),
            F.max("issued_ts").alias("last_issued"),
        )
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Sum, minimum and maximum of partials of the same supplier."""
    return partials.groupBy("supplier_key").agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.try_sum("amount_sum").alias("amount_sum"),
        F.min("first_issued").alias("first_issued"),
        F.max("last_issued").alias("last_issued"),
    )


def finish_summary(merged: DataFrame) -> DataFrame:
    """Rates and means; a supplier without definitive rows or amounts gets null, never NaN."""
    incidents: Column = F.col("observed") + F.col("rejected")
    amount_sum = F.col("amount_sum").cast("double")
    return merged.select(
        "supplier_key",
        *[c for c in _COUNTS if c != "amount_count"],
        amount_sum.alias("amount_sum"),
        "amount_count",
        "first_issued",
        "last_issued",
        incidents.alias("incidents"),
        F.try_divide(incidents, F.col("accepted") + incidents).alias("incident_rate"),
        F.try_divide(amount_sum, F.col("amount_count")).alias("mean_amount"),
    )


def supplier_summary(df: DataFrame) -> DataFrame:
    """Counts per state, amounts, dates, incident rate and mean amount per supplier."""
    return finish_summary(partial_summary(df))


def by_risk(summary: DataFrame) -> DataFrame:
    """Riskiest suppliers first; unknown rates last; the key decides ties."""
    return summary.orderBy(F.desc_nulls_last("incident_rate"), F.desc("invoices"), "supplier_key")


def top_risk_suppliers(summary: DataFrame, limit: int = 10) -> DataFrame:
    return by_risk(summary).limit(limit).select("supplier_key", "invoices", "incidents", "incident_rate")


def summary_totals(summary: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("accepted", "observed", "rejected", "pending")]
    return summary.agg(F.count(F.lit(1)).alias("suppliers"), *sums)
