"""Splits along time. The order is issue time, then an explicit integer tie break.

Only the positions of the borders are computed; the rows themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.ranks import SMALL_ROWS, rows_at_ranks

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def _borders(
    df: DataFrame, issued: str, tie_break: str, ranks: Sequence[int], small_rows: int
) -> list[Column]:
    """One condition per rank: is the row at or after that rank?"""
    positions = df.select(
        F.unix_micros(F.col(issued).cast("timestamp")).alias("_at"), F.col(tie_break).cast("bigint").alias("_tie")
    )
    found = rows_at_ranks(positions, "_at", "_tie", ranks, small_rows)
    at, tie = F.unix_micros(F.col(issued).cast("timestamp")), F.col(tie_break).cast("bigint")
    conditions = []
    for border in found:
        if border is None:
            conditions.append(F.lit(False))
        else:
            conditions.append((at > border[0]) | ((at == border[0]) & (tie >= border[1])))
    return conditions


def usable_rows(df: DataFrame, issued: str = "issued_ts", label: str = "label") -> DataFrame:
    return df.where(F.col(issued).isNotNull() & F.col(label).isNotNull())


def temporal_split(
    df: DataFrame,
    *,
    issued: str = "issued_ts",
    tie_break: str = "row_no",
    label: str = "label",
    share: float = 0.80,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``split``: the last 20 % test, the last 20 % of the rest validation, the rest train."""
    rows = usable_rows(df, issued, label)
    n = rows.count()
    test_start = int(n * share)
    validation_start = int(test_start * share)
    in_validation, in_test = _borders(rows, issued, tie_break, [validation_start, test_start], small_rows)
    name = F.when(in_test, TEST).when(in_validation, VALIDATION).otherwise(TRAIN)
    return rows.withColumn("split", name)


def expanding_folds(
    df: DataFrame,
    folds: int = 3,
    *,
    issued: str = "issued_ts",
    tie_break: str = "row_no",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``fold``: 0 for the first block, k for the block that fold k is judged on.

    Fold k trains on every earlier block. The judged blocks have ``n // (folds + 1)`` rows each and
    the first block takes the remainder.
    """
    n = df.count()
    size = n // (folds + 1)
    starts = [n - (folds - k) * size for k in range(folds)]
    at_or_after = _borders(df, issued, tie_break, starts, small_rows)
    return df.withColumn("fold", reduce(lambda a, b: a + b, [c.cast("int") for c in at_or_after]))


def split_summary(df: DataFrame, issued: str = "issued_ts", label: str = "label") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.to_date(F.min(issued)).alias("first_day"),
        F.to_date(F.max(issued)).alias("last_day"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives, positives and their ratio, each side counted as at least one."""
    negatives, positives = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        (F.greatest(negatives, F.lit(1)) / F.greatest(positives, F.lit(1))).alias("ratio"),
    )
