"""Risk expressions: target, tiers, labels and readable reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import schema as S


def incident_target(state: Column) -> Column:
    """0 for accepted, 1 for observed or rejected, null while nothing is known."""
    return F.when(state == S.ACCEPTED, 0).when(state.isin(S.OBSERVED, S.REJECTED), 1)


def irregular_flag(status: Column, domicile: Column) -> Column:
    """0 only for an active key at a found domicile."""
    return F.when((status == S.STATUS_ACTIVE) & (domicile == S.DOMICILE_FOUND), 0).otherwise(1)


def risk_tier(probability: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return (
        F.when(probability < low, S.TIER_LOW).when(probability < high, S.TIER_MEDIUM).otherwise(S.TIER_HIGH)
    )


def prediction_code(probability: Column, threshold: Column | float) -> Column:
    return F.when(probability >= threshold, 1).otherwise(0)


def prediction_label(code: Column) -> Column:
    return F.when(code == 1, S.LABEL_INCIDENT).when(code == 0, S.LABEL_CLEAN)


def risk_reasons(
    status: Column,
    domicile: Column,
    irregular: Column,
    is_new: Column,
    prev_rate: Column,
    deviation: Column,
    limit: int = 4,
) -> Column:
    """Up to ``limit`` reasons as an array, most important first; a null input gives no reason."""
    candidates = F.array(
        F.when(status != S.STATUS_ACTIVE, F.concat(F.lit(S.REASON_STATUS + " "), status)),
        F.when(domicile != S.DOMICILE_FOUND, F.concat(F.lit(S.REASON_DOMICILE + " "), domicile)),
        F.when(irregular == 1, F.lit(S.REASON_IRREGULAR)),
        F.when(is_new == 1, F.lit(S.REASON_NEW)),
        F.when(prev_rate >= S.LATE_RATE, F.lit(S.REASON_HISTORY)),
        F.when(deviation > 0, F.lit(S.REASON_AMOUNT)),
    )
    return F.slice(F.array_compact(candidates), 1, limit)


def reasons_text(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(F.lit(S.NO_REASON))
