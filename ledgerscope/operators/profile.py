"""Quality profile of an invoice history. Every report is one aggregate over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope import schema as S
from ledgerscope.functions.temporal import whole_days
from ledgerscope.functions.text import is_valid_key
from ledgerscope.operators.history import money
from ledgerscope.operators.ranks import exact_quantiles_of


def _tall(row: DataFrame, names: Sequence[str], name: str, value: str) -> DataFrame:
    """One wide row of totals to (name, value) rows."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS ({name}, {value})")


def null_counts(df: DataFrame) -> DataFrame:
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _tall(totals, df.columns, "column_name", "nulls")


def column_types(df: DataFrame) -> DataFrame:
    """Column order, name and type, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def key_quality(df: DataFrame, key: str = "raw_key") -> DataFrame:
    """Keys that are exactly 11 digits as written, the others, and how many different valid ones."""
    valid = is_valid_key(F.col(key))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid).alias("valid_keys"),
        F.count_if(~valid).alias("invalid_keys"),
        F.count_distinct(F.when(valid, F.trim(key))).alias("unique_valid_keys"),
    )


def date_ranges(df: DataFrame, columns: Sequence[str] = S.DATE_COLUMNS) -> DataFrame:
    """First and last day per date column, missing values and implausible dates."""
    low, high = (F.lit(d).cast("timestamp") for d in S.PLAUSIBLE_DATES)
    stats: list[Column] = []
    for c in columns:
        value = F.col(c)
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.to_date(F.min(value)).alias("first_day"),
                F.to_date(F.max(value)).alias("last_day"),
                F.count_if(value.isNull()).alias("missing"),
                F.count_if((value < low) | (value > high)).alias("out_of_range"),
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def describe_numeric(df: DataFrame, columns: Sequence[str], small_rows: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    limits = {} if small_rows is None else {"small_rows": small_rows}
    stats = []
    found = exact_quantiles_of(df, dict.fromkeys(columns, (0.25, 0.5, 0.75)), **limits)
    for c in columns:
        value, quartiles = F.col(c).cast("double"), found[c]
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), quartiles, strict=True)],
                F.max(value).alias("max"),
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table, missing values included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def term_days(due: Column, issued: Column) -> Column:
    return whole_days(due.cast("timestamp"), issued.cast("timestamp"))


def quality_flags(
    df: DataFrame, raw_amount: str | None = None, raw_dates: dict[str, str] | None = None, uncountable: bool = False
) -> DataFrame:
    """One Boolean column per quality rule.

    ``raw_amount`` and ``raw_dates`` (raw column -> parsed column) add the rules for text that could
    not be converted. ``uncountable`` adds the rule for amounts that sums leave out: not numbers, or too large.
    """
    low, high = (F.lit(d).cast("timestamp") for d in S.PLAUSIBLE_DATES)
    present = [c for c in S.DATE_COLUMNS if c in df.columns]
    outside = F.lit(False)
    for c in present:
        outside = outside | F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
    flags = {
        "negative_amount": F.coalesce(F.col("amount") < 0, F.lit(False)),
        "due_before_issue": F.coalesce(term_days(F.col("due_ts"), F.col("issued_ts")) < 0, F.lit(False)),
        "date_out_of_range": outside,
    }
    if uncountable:
        flags["amount_not_countable"] = F.col("amount").isNotNull() & money(F.col("amount")).isNull()
    if raw_amount is not None:
        flags["amount_unreadable"] = F.col(raw_amount).isNotNull() & F.col("amount").isNull()
    for raw, parsed in (raw_dates or {}).items():
        flags[f"{parsed}_unreadable"] = F.col(raw).isNotNull() & F.col(parsed).isNull()
    return df.withColumns(flags)


def quality_issues(
    df: DataFrame,
    *,
    id_column: str = "invoice_id",
    order: str = "row_no",
    examples: int = 20,
    raw_amount: str | None = None,
    raw_dates: dict[str, str] | None = None,
    uncountable: bool = False,
) -> DataFrame:
    """Rows per broken rule and the first ids that break it, in the order of ``order``.

    The examples are kept by a top-k per rule, never by sorting all rows of a rule in one task.
    """
    flagged = quality_flags(df, raw_amount, raw_dates, uncountable)
    rules = [c for c in flagged.columns if c not in df.columns]
    counts = _tall(flagged.agg(*[F.count_if(F.col(r)).alias(r) for r in rules]), rules, "rule", "rows")
    broken = flagged.select(
        F.col(order).alias("_order"),
        F.col(id_column).alias("_id"),
        F.explode(F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules]), lambda r: r.isNotNull())).alias("rule"),
    )
    # Spark keeps the first rows of each rule in every task, before the shuffle.
    first = Window.partitionBy("rule").orderBy("_order")
    tops = broken.withColumn("_row", F.row_number().over(first)).where(F.col("_row") <= examples)
    lists = tops.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("_order", "_id"))).alias("_ids"))
    joined = counts.join(F.broadcast(lists), "rule", "left")  # one row per rule on both sides
    ids = F.array_join(F.transform("_ids", lambda e: e["_id"]), ",")
    return joined.select("rule", "rows", F.coalesce(ids, F.lit("")).alias("examples"))


def duplicate_ids(df: DataFrame, id_column: str = "invoice_id", key: str | None = "supplier_key") -> DataFrame:
    """Totals of repeated ids.

    ``repeated_ids`` and ``surplus_rows`` look at rows with a key and an id; ``rows_in_groups`` and
    ``distinct_in_groups`` at all rows, where missing ids form one group of duplicates.
    """
    keyed = F.col(key).isNotNull() if key else F.lit(True)
    groups = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), F.count_if(keyed).alias("n_keyed"))
    has_id = F.col(id_column).isNotNull()
    again = F.col("n_keyed") > 1

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    return groups.agg(
        F.count_if(has_id & again).alias("repeated_ids"),
        total(has_id & again, F.col("n_keyed") - 1).alias("surplus_rows"),
        total(F.col("n") > 1, F.col("n")).alias("rows_in_groups"),
        F.count_if(has_id & (F.col("n") > 1)).alias("distinct_in_groups"),
    )


def top_duplicate_ids(df: DataFrame, id_column: str = "invoice_id", limit: int = 20) -> DataFrame:
    groups = value_counts(df, id_column).where(F.col("n") > 1)
    return groups.orderBy(F.desc("n"), F.col(id_column).asc_nulls_last()).limit(limit)


def dataset_summary(df: DataFrame, key: str = "supplier_key", issued: str = "issued_ts") -> DataFrame:
    """Rows, different keys and first and last issue day."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("suppliers"),
        F.to_date(F.min(issued)).alias("first_day"),
        F.to_date(F.max(issued)).alias("last_day"),
    )
