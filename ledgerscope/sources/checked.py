"""Writes that keep what they refuse: good and rejected rows from one pass over the source.

A row is checked by named rules. It is written once, to the good or to the rejected part, where it keeps its values as read and the
names of all rules that it breaks. The counts come from that one narrow column of what was written, so the source is read once. (They are
not observed during the write: a session that has made an ``Observation`` can no longer send MLlib models to its executors.)
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.temporal import parse_day_first
from ledgerscope.functions.text import normalize_key, parse_amount

REASONS, REJECTED = "reasons", "rejected"


def _given(column: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit("")).isNotNull()


def invalid_key(column: str) -> Column:
    return normalize_key(F.col(f"`{column}`").cast("string")).isNull()


def unreadable_date(column: str) -> Column:
    return _given(column) & parse_day_first(F.col(f"`{column}`").cast("string")).isNull()


def unreadable_int(column: str) -> Column:
    return _given(column) & F.trim(F.col(f"`{column}`").cast("string")).try_cast("int").isNull()


def unreadable_amount(column: str) -> Column:
    return _given(column) & parse_amount(F.col(f"`{column}`").cast("string")).isNull()


def missing_value(column: str) -> Column:
    return ~_given(column)


@dataclass
class Checked:
    """The two parts, and how many rows were read, rejected, and broke each rule."""

    good: DataFrame
    rejected: DataFrame
    rows: int
    rejected_rows: int
    broken: dict[str, int]


def with_reasons(df: DataFrame, rules: Mapping[str, Column], column: str = REASONS) -> DataFrame:
    """Add the names of the broken rules, in the order of the rules; a rule that is null is not broken."""
    marks = [F.when(broken, F.lit(name)) for name, broken in rules.items()]
    return df.withColumn(column, F.filter(F.array(*marks), lambda m: m.isNotNull()) if marks else F.array().cast("array<string>"))


def write_checked(df: DataFrame, rules: Mapping[str, Column], path: str) -> Checked:
    """Write the rows below ``path`` in the parts ``rejected=false`` and ``rejected=true`` and return both with their counts.

    Columns named ``reasons`` or ``rejected`` are replaced. An empty table gives two empty parts.
    """
    names = list(rules)
    df = df.drop(REASONS, REJECTED)
    marked = with_reasons(df, rules)
    marked.withColumn(REJECTED, F.size(REASONS) > 0).write.mode("overwrite").partitionBy(REJECTED).parquet(path)
    schema = T.StructType([*marked.schema.fields, T.StructField(REJECTED, T.BooleanType())])
    written = df.sparkSession.read.schema(schema).parquet(path)
    found = written.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(REJECTED)).alias("rejected"),
        *[F.count_if(F.array_contains(REASONS, n)).alias(f"rule_{i}") for i, n in enumerate(names)],
    ).first()
    return Checked(
        good=written.where(~F.col(REJECTED)).drop(REASONS, REJECTED),
        rejected=written.where(REJECTED).drop(REJECTED),
        rows=found["rows"],
        rejected_rows=found["rejected"],
        broken={n: found[f"rule_{i}"] for i, n in enumerate(names)},
    )
