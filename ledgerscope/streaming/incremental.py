"""Incremental versions of the supplier summary and of the registry upsert.

Both are restartable: a micro-batch writes to a place named after its number and replaces what an
earlier attempt of the same batch left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators.enrich import prepare_upsert_source
from ledgerscope.operators.summary import clean_history, finish_summary, merge_partials, partial_summary
from ledgerscope.sources.workspace import exists
from ledgerscope.streaming.bucket_store import snapshot, upsert_buckets

BATCH = "batch"


def run_summary_stream(invoices: DataFrame, path: str, *, raw_key: str = "raw_key") -> None:
    """Write mergeable partials of every micro-batch under ``path`` until the input is used up."""

    def store(batch: DataFrame, number: int) -> None:
        partials = partial_summary(clean_history(batch, raw_key))
        partials.write.mode("overwrite").parquet(f"{path}/partials/{BATCH}={number}")

    stream = (
        invoices.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def _compacted(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest merged partials, and the last batch in them."""
    if not exists(spark, f"{path}/compacted"):
        return None, -1
    merged = spark.read.parquet(f"{path}/compacted")
    last = merged.agg(F.max("upto").alias("v")).first()["v"]
    return (None, -1) if last is None else (merged.where(F.col("upto") == last).drop("upto"), last)


def _partials(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """One table of partials: the compacted ones and those of later batches."""
    merged, last = _compacted(spark, path)
    later = spark.read.parquet(f"{path}/partials").where(F.col(BATCH) > last)
    later = (later if upto is None else later.where(F.col(BATCH) <= upto)).drop(BATCH)
    return later if merged is None else merged.unionByName(later)


def compact_summary(spark: SparkSession, path: str) -> None:
    """Merge the partials of all finished batches, so that later reads start from one row per supplier.

    To be called between runs of the stream. A batch number is announced in the folder name, so a repeated
    call replaces what a broken one left. Folders of older batches may be deleted once no reader uses them.
    """
    last = spark.read.parquet(f"{path}/partials").agg(F.max(BATCH).alias("v")).first()["v"]
    if last is not None and last > _compacted(spark, path)[1]:
        merge_partials(_partials(spark, path, last)).write.mode("overwrite").parquet(f"{path}/compacted/upto={last}")


def merged_summary(spark: SparkSession, path: str) -> DataFrame:
    """Supplier summary of all batches so far; equal to the summary of all invoices at once."""
    return finish_summary(merge_partials(_partials(spark, path)))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the registry store, or ``None`` while it is empty."""
    return snapshot(spark, path)


def upsert_batch(spark: SparkSession, source: DataFrame, path: str, number: int) -> DataFrame:
    """Merge one batch into the store as a new version and return its statistics; only changed buckets are written anew."""
    return upsert_buckets(spark, source, path, number)


def run_upsert_stream(registry: DataFrame, path: str, order: str, flags: DataFrame | None = None) -> None:
    """Upsert every micro-batch of registry rows into the store under ``path``."""

    def merge(batch: DataFrame, number: int) -> None:
        source = prepare_upsert_source(batch, flags, order)
        upsert_batch(batch.sparkSession, source, path, number)

    stream = (
        registry.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def upsert_history(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of every version of the store."""
    return spark.read.parquet(f"{path}/versions").drop("number")
