"""Dates: tolerant parsing, strict conversion and calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted layouts, with ``-`` for any of ``- / .`` and a blank for ``T``. ISO is told by
# its shape, so ISO text is never read day-first. Two-digit years from 69 on belong to the last century.
ISO_SHAPE = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
OTHER_SHAPE = "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
TIME_SHAPE = "( [0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?$"
ISO_LAYOUT = "yyyy-M-d[ H:m[:s]]"
DAY_FIRST_LAYOUT = "d-M-yyyy[ H:m[:s]]"
MONTH_FIRST_LAYOUT = "M-d-yyyy[ H:m[:s]]"
FRACTION = r"(:[0-9]{1,2})[.,]([0-9]{1,9})"
ZONE = r"(:[0-9]{1,2}(?:[.,][0-9]{1,9})?) ?(?:[zZ]|([+-])([0-9]{2}):?([0-9]{2})?)$"

MICROS_PER_DAY = 86_400_000_000


def _extras(value: Column) -> Column:
    """Microseconds that a fraction of a second adds, and an offset from UTC takes away."""
    fraction = F.rpad(F.regexp_extract(value, FRACTION, 2), 6, "0").cast("bigint")
    sign, hours, minutes = (F.regexp_extract(value, ZONE, i) for i in (2, 3, 4))
    offset = (F.nullif(hours, F.lit("")).cast("bigint") * 60 + F.coalesce(F.nullif(minutes, F.lit("")).cast("bigint"), F.lit(0))) * (
        60_000_000
    )
    return fraction - F.coalesce(F.when(sign == "-", -offset).otherwise(offset), F.lit(0))


def _parse(value: Column, other_layout: str) -> Column:
    """Only text of the right shape is parsed: a failing parse is costly. Times with an offset become UTC."""
    trimmed = F.trim(value)
    whole = F.regexp_replace(F.regexp_replace(trimmed, ZONE, "$1"), FRACTION, "$1")
    text = F.translate(whole, "/.T", "-- ")
    text = F.regexp_replace(text, "^([0-9]{4})([0-9]{2})([0-9]{2})(?= |$)", "$1-$2-$3")
    text = F.regexp_replace(text, "^([0-9]{1,2}-[0-9]{1,2}-)(6[9]|[7-9][0-9])(?= |$)", "$119$2")
    text = F.regexp_replace(text, "^([0-9]{1,2}-[0-9]{1,2}-)([0-9]{2})(?= |$)", "$120$2")
    parsed = F.when(text.rlike(ISO_SHAPE + TIME_SHAPE), F.try_to_timestamp(text, F.lit(ISO_LAYOUT))).when(
        text.rlike(OTHER_SHAPE + TIME_SHAPE), F.try_to_timestamp(text, F.lit(other_layout))
    )
    extra = F.when(trimmed.rlike(f"{FRACTION}|{ZONE}"), _extras(trimmed)).otherwise(F.lit(0))
    return F.timestamp_micros(F.unix_micros(parsed) + extra)


def parse_day_first(value: Column) -> Column:
    return _parse(value, DAY_FIRST_LAYOUT)


def parse_month_first(value: Column) -> Column:
    return _parse(value, MONTH_FIRST_LAYOUT)


def parse_date_columns(df: DataFrame, columns: Sequence[str], min_share: float = 0.5) -> DataFrame:
    """Parse text dates day-first; a column that mostly fails is parsed month-first instead.

    The shares of all columns come from one aggregate (a single row reaches the driver).
    """
    if not columns:
        return df
    shares = df.agg(
        *[F.avg(parse_day_first(F.col(c)).isNotNull().cast("int")).alias(c) for c in columns]
    ).first()
    parsers = {c: parse_month_first if (shares[c] or 0.0) < min_share else parse_day_first for c in columns}
    return df.withColumns({c: parse(F.col(c)) for c, parse in parsers.items()})


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded towards the past."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("int")


def strict_date(value: Column) -> Column:
    """Date conversion that fails the job on text that is not blank and not a date."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    parsed = parse_day_first(text).cast("date")
    error = F.raise_error(F.concat(F.lit("not a date: "), text))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(error.cast("date"))


def strict_int(value: Column) -> Column:
    """Integer conversion that fails the job on text that is not blank and not an integer."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    parsed = text.try_cast("int")
    error = F.raise_error(F.concat(F.lit("not an integer: "), text))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(error.cast("int"))


def conversion_rejects(df: DataFrame, dates: Sequence[str] = (), ints: Sequence[str] = ()) -> DataFrame:
    """One row with the number of values per column that the strict conversions would refuse."""

    def bad(name: str, parsed: Column) -> Column:
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        return F.count_if(text.isNotNull() & parsed.isNull()).alias(name)

    checks = [bad(c, parse_day_first(F.col(c).cast("string"))) for c in dates]
    checks += [bad(c, F.trim(F.col(c).cast("string")).try_cast("int")) for c in ints]
    return df.agg(*checks)
