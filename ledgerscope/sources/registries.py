"""Registry and membership list text files.

Lines are read as bytes and decoded here, because a damaged line must neither swallow its
neighbours nor depend on which columns a query happens to read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.text import normalize_key
from ledgerscope.operators.enrich import dedup_by_key


def _lines(spark: SparkSession, path: str, encoding: str, line_sep: str | None = None) -> DataFrame:
    """Lines with a number that follows file name and position in the file."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    lines = reader.text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("line"), _place())
    return lines.select(F.regexp_replace("line", "[\\r\\n]+$", "").alias("line"), "line_no")


def _place() -> Column:
    """Where a row comes from: file, block and a number that increases with the position inside the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    ).alias("line_no")


def _fields(line: Column, sep: str) -> Column:
    return F.split(line, "\\Q" + sep + "\\E", -1)


def registry_column_names(count: int) -> list[str]:
    """Positional names, continued by ``column_<n>`` when the file is wider."""
    known = list(S.REGISTRY_FILE_COLUMNS)
    return known[:count] + [f"column_{i}" for i in range(len(known), count)]


def read_registry(
    spark: SparkSession,
    path: str,
    *,
    sep: str = "|",
    encoding: str = "ISO-8859-1",
    header: bool = True,
    column_count: int = len(S.REGISTRY_FILE_COLUMNS),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Registry lines as text columns plus ``line_no``.

    Lines with too many fields are skipped, a separator at the end of the line aside; short lines
    are filled with null. Quotes have no meaning, so a stray quote in a name stays a character.
    """
    names = list(columns) if columns else registry_column_names(column_count)
    parts = _lines(spark, path, encoding).withColumn("parts", _fields(F.col("line"), sep))
    width = F.size("parts") - F.when(F.element_at("parts", -1) == "", 1).otherwise(0)
    kept = parts.where((F.length("line") > 0) & (width <= len(names)))
    table = kept.select(*[F.get("parts", F.lit(i)).alias(n) for i, n in enumerate(names)], "line_no")
    if header:
        first = F.coalesce(F.col(names[0]), F.lit(""))
        table = table.where(~F.upper(F.trim(first)).isin("RUC", names[0].upper()))
    return table


def read_membership_list(
    spark: SparkSession, path: str, *, encoding: str = "ISO-8859-1", line_sep: str | None = None, header: bool = True
) -> DataFrame:
    """Membership list: key, name, since, resolution, separated by pipes; the first line of a key wins.

    Records end in a carriage return, a line feed or both, unless ``line_sep`` says otherwise.
    """
    parts = _lines(spark, path, encoding, line_sep).withColumn(
        "parts", _fields(F.regexp_replace("line", "^[\\r\\n]+", ""), "|")
    )
    rows = parts.where((F.size("parts") >= 3) & (F.trim(F.get("parts", F.lit(0))) != ""))
    members = rows.select(
        normalize_key(F.get("parts", F.lit(0))).alias("supplier_key"),
        F.regexp_replace(F.trim(F.get("parts", F.lit(1))), '^"+|"+$', "").alias("name"),
        F.trim(F.get("parts", F.lit(2))).alias("since"),
        "line_no",
    ).where(F.col("supplier_key").isNotNull())  # a header has no digits in the key column
    return dedup_by_key(members, "supplier_key", "line_no", keep="first").drop("line_no")


def read_membership_flags(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    """Stored 0/1 flags; columns that the file lacks are 0; one row per key."""
    df = spark.read.parquet(path) if format == "parquet" else spark.read.csv(path, header=True)
    flags = {f: F.coalesce(F.col(f).try_cast("int"), F.lit(0)) if f in df.columns else F.lit(0) for f in S.LIST_FLAGS}
    rows = df.select(
        normalize_key(F.col("supplier_key")).alias("supplier_key"),
        F.struct(*[e.alias(f) for f, e in flags.items()]).alias("flags"),
        _place(),
    ).where(F.col("supplier_key").isNotNull())
    first = rows.groupBy("supplier_key").agg(F.min_by("flags", "line_no").alias("flags"))
    return first.select("supplier_key", "flags.*")
