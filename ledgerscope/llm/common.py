"""Small expressions that the operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.workspace import materialize

#: What counts as white space, and what a word is.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow table to the shared folder and read it back.

    The lineage ends there, nothing above is computed twice, and since a file has no partitioning,
    a join shuffles both sides, so that adaptive execution may split hot keys or broadcast a side
    that has turned out small.
    """
    return materialize(df, f"llm-{name}")


def unfolded(df: DataFrame) -> DataFrame:
    """A table that an explode has made long, as a side of a join that shuffles both.

    Spark sizes it as if the explode added no rows, and would send it to all executors through the driver.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def whole_text(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash128(value: Column) -> tuple[Column, Column]:
    """A 128-bit hash as two integers with different seeds."""
    return F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value)


def uniform52(*parts: Column) -> Column:
    """An integer in [0, 2**52) drawn from the text of the parts; null reads as ``null``."""
    name = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator uses for its results."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


#: So many narrow rows are broadcast at most: some 64 MB.
BROADCAST_ROWS = 500_000


def drop_listed(docs: DataFrame, listed: DataFrame, same: Column) -> DataFrame:
    """The rows of ``docs`` that no row of ``listed`` (a stored table of ids and hashes) is the ``same`` as.

    A list of checked size is broadcast, so the texts stay where they are; beside a longer one they are shuffled once.
    """
    few = listed.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(listed) if few else listed, same, "left_anti")
