"""Analytic queries of a risk dashboard over scored pending invoices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope import schema as S
from ledgerscope.functions.text import best_name, mask, month_label
from ledgerscope.operators.history import money
from ledgerscope.operators.ranks import exact_quantiles


def _is_high() -> Column:
    return F.col("tier") == S.TIER_HIGH


def supplier_name(df: DataFrame) -> Column:
    """Imported name, else registry name, else empty."""
    return best_name(*[F.col(c) for c in ("supplier_name", "legal_name") if c in df.columns])


def has_names(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(supplier_name(df) != ""), F.lit(False)).alias("has_names"))


def mask_private(df: DataFrame, replacement: str = "***") -> DataFrame:
    """Names and addresses hidden behind a constant; empty ones stay empty."""
    return df.withColumns({c: mask(F.col(c), replacement) for c in S.PRIVATE_COLUMNS if c in df.columns})


# --------------------------------------------------------------------------- headline numbers
def kpis(pred: DataFrame) -> DataFrame:
    total, high, flagged = F.count(F.lit(1)), F.count_if(_is_high()), F.count_if(F.col("code") == 1)

    def percent(part: Column) -> Column:
        return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))

    return pred.agg(
        total.alias("pending"),
        high.alias("high_risk"),
        percent(high).alias("high_risk_pct"),
        flagged.alias("flagged"),
        percent(flagged).alias("flagged_pct"),
        F.coalesce(F.avg("probability"), F.lit(0.0)).alias("mean_probability"),
    )


def tier_counts(pred: DataFrame) -> DataFrame:
    """Every tier in business order, also the empty ones, with share and mean probability."""
    totals = pred.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.struct(F.count_if(F.col("tier") == t).alias("n"), F.avg(F.when(F.col("tier") == t, F.col("probability"))).alias("p")).alias(t)
            for t in S.TIERS
        ],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("tier_order"),
                F.lit(t).alias("tier"),
                F.col(f"{t}.n").alias("n"),
                (F.col(f"{t}.n") / F.greatest("total", F.lit(1))).alias("share"),
                F.coalesce(F.col(f"{t}.p"), F.lit(0.0)).alias("mean_probability"),
            )
            for i, t in enumerate(S.TIERS)
        ]
    )
    return totals.select(F.inline(entries))


# --------------------------------------------------------------------------- time
def risk_by_month(pred: DataFrame) -> DataFrame:
    """Mean probability and high-risk count per month of issue."""
    return (
        pred.where(F.col("issued_ts").isNotNull())
        .groupBy(F.trunc("issued_ts", "month").alias("month"))
        .agg(
            F.avg("probability").alias("mean_probability"),
            F.count_if(_is_high()).alias("high_risk"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def monthly_smooth(monthly: DataFrame) -> DataFrame:
    """Centered mean over three rows and the month of the maximum (the earliest one on ties).

    The input has one row per calendar month, so a window over all rows is small.
    """
    centered = Window.orderBy("month").rowsBetween(-1, 1)
    by_risk = Window.orderBy(F.desc("mean_probability"), "month")
    return monthly.withColumns(
        {"smoothed": F.avg("mean_probability").over(centered), "is_peak": F.row_number().over(by_risk) == 1}
    )


def risk_heatmap(pred: DataFrame, max_months: int = 12) -> DataFrame:
    """Mean probability per document type and month, over the last months that occur.

    Long form: ``row_mean`` is the mean of the cells of a type, ``n`` the true number of invoices.
    """
    rows = pred.where(F.col("issued_ts").isNotNull()).withColumn("month", F.trunc("issued_ts", "month"))
    cells = rows.groupBy("doc_type", "month").agg(
        F.avg("probability").alias("mean_probability"), F.count(F.lit(1)).alias("n")
    )
    last = cells.select("month").distinct().orderBy(F.desc("month")).limit(max_months)
    cells = cells.join(F.broadcast(last), "month", "left_semi")  # at most max_months rows
    means = cells.groupBy("doc_type").agg(F.avg("mean_probability").alias("row_mean"))
    return cells.join(means, "doc_type").select(
        "doc_type", "month", month_label(F.col("month")).alias("month_label"), "mean_probability", "n", "row_mean"
    )


def risk_heatmap_wide(pred: DataFrame, max_months: int = 12) -> DataFrame:
    """The heat map with one column per month, riskiest document types first."""
    cells = risk_heatmap(pred, max_months)
    months = [r["month"] for r in cells.select("month").distinct().orderBy("month").limit(max_months).collect()]
    labels = [f"{S.MONTH_NAMES[m.month - 1]} {m.year % 100:02d}" for m in months]
    wide = cells.groupBy("doc_type", "row_mean").agg(
        *[
            F.max(F.when(F.col("month") == F.lit(m), F.col("mean_probability"))).alias(label)
            for m, label in zip(months, labels, strict=True)
        ]
    )
    return wide.orderBy(F.desc("row_mean"), "doc_type").drop("row_mean")


# --------------------------------------------------------------------------- reasons and suppliers
def top_risk_factors(pred: DataFrame, limit: int = 6) -> DataFrame:
    """Most frequent reasons of high-risk invoices; variants of status and domicile count as one."""
    reasons = (
        pred.where(_is_high())
        .select(F.explode(F.split("reasons", ";")).alias("factor"))
        .select(F.trim("factor").alias("factor"))
        .where((F.col("factor") != "") & (F.col("factor") != S.NO_REASON))
    )
    pattern = f"^({S.REASON_STATUS}|{S.REASON_DOMICILE}) .+$"
    folded = reasons.select(F.regexp_replace("factor", pattern, "$1" + S.REASON_VARIANT_SUFFIX).alias("factor"))
    counts = folded.groupBy("factor").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "factor").limit(limit)


def top_risk_suppliers(pred: DataFrame, limit: int = 10, order: str = "row_no") -> DataFrame:
    """Suppliers with most high-risk invoices; the name comes from their first invoice."""
    grouped = (
        pred.where(_is_high() & F.col("supplier_key").isNotNull())
        .groupBy("supplier_key")
        .agg(
            F.count(F.lit(1)).alias("high_risk"),
            F.avg("probability").alias("mean_probability"),
            F.try_sum(money(F.col("amount"))).cast("double").alias("amount"),
            F.min_by(supplier_name(pred), F.col(order)).alias("name"),
        )
    )
    return grouped.orderBy(F.desc("high_risk"), F.desc("mean_probability"), "supplier_key").limit(limit)


def membership_risk(pred: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """High-risk share inside and outside each list; lists without members are left out.

    One aggregate for all lists, then one row per list.
    """
    present = {c: label for c, label in labels.items() if c in pred.columns}

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, _is_high().cast("int"))) * 100

    stats = []
    for column, label in present.items():
        inside = F.coalesce(F.col(column) == 1, F.lit(False))
        stats.append(
            F.struct(
                F.lit(label).alias("list"),
                share(inside).alias("inside_pct"),
                F.coalesce(share(~inside), F.lit(0.0)).alias("outside_pct"),
                F.count_if(inside).alias("invoices"),
            )
        )
    return pred.agg(F.array(*stats).alias("stats")).select(F.inline("stats")).where(F.col("invoices") > 0)


def membership_coverage(flags: DataFrame) -> DataFrame:
    return flags.agg(*[F.coalesce(F.sum(F.col(f).cast("bigint")), F.lit(0)).alias(f) for f in S.LIST_FLAGS])


# --------------------------------------------------------------------------- filters and lists
def filter_predictions(
    pred: DataFrame,
    *,
    tier: str = S.ANY_TIER,
    text: str = "",
    doc_type: str | None = None,
    supplier_key: str | None = None,
    factor: str | None = None,
) -> DataFrame:
    """All given filters at once. Text and factor are literal; text ignores case."""
    condition = F.lit(True)
    if tier and tier != S.ANY_TIER:
        condition = condition & (F.col("tier") == tier)
    if doc_type:
        condition = condition & (F.col("doc_type") == doc_type)
    if supplier_key:
        condition = condition & (F.col("supplier_key") == supplier_key)
    if factor:
        wanted = factor.replace(S.REASON_VARIANT_SUFFIX, "")
        condition = condition & F.contains(F.coalesce("reasons", F.lit("")), F.lit(wanted))
    text = (text or "").strip().lower()
    if text:
        searched = F.lower(F.concat_ws(" ", "invoice_id", "supplier_key", supplier_name(pred)))
        condition = condition & F.contains(searched, F.lit(text))
    return pred.where(condition)


def priority_queue(pred: DataFrame, limit: int = 50, order: str = "row_no") -> DataFrame:
    """The most probable incidents first; a top-k, not a full sort."""
    return pred.orderBy(F.desc("probability"), order).limit(limit)


def export_rows(filtered: DataFrame, order: str = "row_no") -> DataFrame:
    """Filtered predictions with the best name, most probable first, ready for a writer."""
    named = filtered.withColumn("best_name", supplier_name(filtered))
    return named.orderBy(F.desc("probability"), order)


def amount_sample(pred: DataFrame, size: int = 4000, seed: int = S.SEED, order: str = "row_no") -> DataFrame:
    """Repeatable sample of invoices with a positive amount: the smallest seeded hashes win."""
    eligible = pred.where((F.col("amount") > 0) & F.col("probability").isNotNull() & F.col("tier").isNotNull())
    rank = F.md5(F.concat(F.col(order).cast("string"), F.lit(f":{seed}")))
    return eligible.orderBy(rank, order).limit(size)


def critical_quadrant(pred: DataFrame, threshold: float) -> DataFrame:
    """Invoices above the median of positive amounts and at or above the threshold."""
    median = exact_quantiles(pred.where(F.col("amount") > 0), "amount", [0.5])[0]
    if median is None:
        return pred.limit(0)
    return pred.where((F.col("amount") > median) & (F.col("probability") >= threshold))
