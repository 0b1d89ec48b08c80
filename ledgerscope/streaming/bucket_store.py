"""A keyed table in hash buckets, of which a batch rewrites only those that it changes.

Below the store's folder:

* ``data/version=N/bucket=B/``: the rows of a bucket as batch N left them. Files never change.
* ``manifests/version=N/``: a row per bucket that has rows, with the version that holds them. It is written last and is the
  commit: what no manifest names does not exist, so a broken batch leaves nothing that a reader could see.

A batch reads the buckets that its keys hit, merges them and writes them below its own number; buckets in which nothing was inserted
or updated keep their files. Repeating a batch starts from the manifest before it and gives the same result.
The number of buckets is fixed when the store is made; the driver sees the manifest, which has a row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.operators.enrich import classify_upsert, upsert_stats
from ledgerscope.sources.workspace import exists

BUCKETS = 64
KEY = "supplier_key"
_MANIFEST = "bucket int, held_by bigint, buckets int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, int], int | None]:
    """The newest manifest (older than ``before``) as bucket: version, and the number of buckets of the store."""
    if not exists(spark, f"{path}/manifests"):
        return {}, None
    every = spark.read.parquet(f"{path}/manifests")
    if before is not None:
        every = every.where(F.col("version") < before)
    last = every.agg(F.max("version").alias("v")).first()["v"]
    if last is None:
        return {}, None
    rows = every.where(F.col("version") == last).collect()  # one per bucket, and one for the store
    return {r["bucket"]: r["held_by"] for r in rows if r["bucket"] is not None}, rows[0]["buckets"]


def _rows(spark: SparkSession, path: str, held: dict[int, int], schema: T.StructType) -> DataFrame:
    """The rows of the given buckets; only their folders are listed and read."""
    if not held:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/version={version}/bucket={bucket}" for bucket, version in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders)


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the store, or ``None`` while it has no version."""
    held, buckets = _manifest(spark, path)
    if buckets is None:
        return None
    return _rows(spark, path, held, _stored_schema(spark, path))


def _stored_schema(spark: SparkSession, path: str) -> T.StructType:
    schema = spark.read.parquet(f"{path}/schema").schema
    return T.StructType([f for f in schema.fields if f.name not in ("version", "bucket")])


def rewritten_buckets(spark: SparkSession, path: str, number: int) -> list[int]:
    """The buckets that a version wrote anew."""
    held, _ = _manifest(spark, path, number + 1)
    return sorted(b for b, version in held.items() if version == number)


def upsert_buckets(spark: SparkSession, source: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """Merge one batch (one row per key) into the store as version ``number``; its statistics."""
    held, known = _manifest(spark, path, number)
    buckets = known or buckets
    schema = T.StructType([f for f in source.schema.fields])
    if known is None:
        source.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    batch = source.withColumn("bucket", bucket_of(F.col(KEY), buckets))
    hit = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most all buckets
    target = _rows(spark, path, {b: held[b] for b in hit if b in held}, schema)
    merged = classify_upsert(target, source).withColumn("bucket", bucket_of(F.col(KEY), buckets))
    folder = f"{path}/data/version={number}"
    (
        merged.repartition(F.col("bucket")).sortWithinPartitions("bucket", KEY)
        .write.mode("overwrite").partitionBy("bucket").parquet(folder)
    )
    if hit:
        written = spark.read.schema(T.StructType([*merged.schema.fields])).parquet(folder)
        changed = [r["bucket"] for r in written.where(F.col("action").isin("inserted", "updated")).select("bucket").distinct().collect()]
    else:
        written, changed = merged.limit(0), []
    stats = upsert_stats(written).withColumn("version", F.lit(number).cast("bigint"))
    stats.write.mode("overwrite").parquet(f"{path}/versions/number={number}")
    now = held | dict.fromkeys(changed, number)
    entries = [(b, v, buckets) for b, v in sorted(now.items())] or [(None, None, buckets)]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={number}")
    return spark.read.parquet(f"{path}/versions/number={number}")
