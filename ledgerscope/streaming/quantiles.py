"""Quantiles of a growing history from mergeable sketches.

Every micro-batch leaves one sketch per column, a few kilobytes whatever the batch holds. Merging all of them gives the quantiles of all
rows so far, without reading a row again. A sketch of size ``SIZE`` puts a value at a rank that differs from its true one by
less than ``RANK_ERROR`` of the rows (at 99 % confidence for one quantile). Missing values are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 800
RANK_ERROR = 0.005
BATCH = "batch"


def quantile_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows, sketch`` of each column; a column without values has no sketch."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("rows"),
            F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SIZE)).alias("sketch"),
        )
        for c in columns
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e")).where("rows > 0")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``column, share, value`` of merged sketches."""
    wanted = F.array(*[F.lit(float(q)) for q in shares])
    values = F.arrays_zip(wanted.alias("share"), F.kll_sketch_get_quantile_double("sketch", wanted).alias("value"))
    return sketches.select("column", F.explode(values).alias("z")).select("column", "z.share", "z.value")


def run_quantile_stream(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write the sketches of every micro-batch under ``path`` until the input is used up; a repeated batch replaces its own."""

    def store(batch: DataFrame, number: int) -> None:
        quantile_sketches(batch, columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/sketches/{BATCH}={number}")

    stream = (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def merged_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all batches so far."""
    return merge_sketches(spark.read.parquet(f"{path}/sketches").drop(BATCH))
