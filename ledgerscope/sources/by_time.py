"""A dataset in files by time, with a table of what each file holds.

Rows are cut into ranges of (time, tie break), sorted, and written a file per range. A small table beside them has the first and last time of
every file and its number of rows, so a time split or a query on some months opens only the files it needs, and the first and last
time of all need no data file at all. Rows without a time come last; their files are opened only when they are asked for.

The files of a write go to a folder of its own, and the table of files is written last: a broken write leaves nothing that a reader
would find, and after a second write readers see the new files only. An empty table has no file, and is read as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerscope.sources.workspace import exists

ROWS_PER_FILE = 2_000_000


def write_by_time(
    df: DataFrame,
    path: str,
    *,
    issued: str = "issued_ts",
    tie_break: str = "row_no",
    rows_per_file: int = ROWS_PER_FILE,
    files: int | None = None,
) -> None:
    """Write a new version of the dataset, in about ``files`` files, or by the number of rows."""
    spark = df.sparkSession
    files = files or max(1, math.ceil(df.count() / rows_per_file))
    folder = f"data-{uuid.uuid4().hex}"
    order = [F.col(issued).asc_nulls_last(), F.col(tie_break).asc()]
    ranged = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged.write.option("compression", "zstd").parquet(f"{path}/{folder}")

    last = _newest(spark, path)
    version = F.lit(0 if last is None else last[0] + 1).alias("version")
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    held = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(issued).alias("first"), F.max(issued).alias("last"), F.count(F.lit(1)).alias("rows"), F.count(issued).alias("timed")
    )
    # One folder of statistics per version: its one file is there as a whole, or not at all.
    facts = held.select(version, F.lit(folder).alias("folder"), F.lit(df.schema.json()).alias("schema"), "file", "first", "last", "rows", "timed")
    head = spark.range(1).select(
        version, F.lit(folder).alias("folder"), F.lit(df.schema.json()).alias("schema"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast(held.schema["first"].dataType).alias("first"), F.lit(None).cast(held.schema["last"].dataType).alias("last"),
        F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("timed"),
    )
    facts.unionByName(head).coalesce(1).write.mode("append").parquet(f"{path}/files")


def _newest(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    if not exists(spark, f"{path}/files"):
        return None
    row = spark.read.parquet(f"{path}/files").where(F.col("file").isNull()).orderBy(F.desc("version"), F.desc("folder")).first()
    return row["version"], row["folder"], row["schema"]


def time_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of the newest version: ``file, first, last, rows, timed``."""
    last = _newest(spark, path)
    if last is None:
        raise ValueError("dataset by time: nothing written")
    files = spark.read.parquet(f"{path}/files").where((F.col("folder") == last[1]) & F.col("file").isNotNull())
    return files.select("file", "first", "last", "rows", "timed")


def read_between(
    spark: SparkSession,
    path: str,
    start: datetime | Column | None = None,
    end: datetime | Column | None = None,
    *,
    issued: str = "issued_ts",
    untimed: bool = False,
) -> DataFrame:
    """Rows with a time from ``start`` on and before ``end``, either may be open; with ``untimed`` also those without a time."""
    last = _newest(spark, path)
    if last is None:
        raise ValueError("dataset by time: nothing written")
    start, end = (v if v is None or isinstance(v, Column) else F.lit(v) for v in (start, end))

    def within(first: Column, final: Column, no_time: Column) -> Column:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (final >= start)
        if end is not None:
            inside = inside & (first < end)
        inside = F.coalesce(inside & first.isNotNull(), F.lit(False))
        return inside | no_time if untimed else inside

    wanted = time_files(spark, path).where(within(F.col("first"), F.col("last"), F.col("rows") > F.col("timed")))
    names = sorted(r["file"] for r in wanted.select("file").collect())  # one per file, as in any listing of a folder
    schema = StructType.fromJson(json.loads(last[2]))
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{last[1]}/{n}" for n in names])
    return rows.where(within(F.col(issued), F.col(issued), F.col(issued).isNull()))
