from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import enrich, summary
from ledgerscope.sources.workspace import materialize, workspace
from ledgerscope.streaming import bucket_store, incremental, quantiles

ROWS = [(str(i % 4), "Observada" if i % 3 else "Aceptada", float(i), None) for i in range(40)]
SCHEMA = "raw_key string, state string, amount double, issued_ts timestamp"


def test_summary_stream_equals_batch_and_continues(spark):
    path, files = workspace(spark, "stream"), workspace(spark, "input")
    df = spark.createDataFrame(ROWS, SCHEMA)
    for part in (df.where("amount < 10"), df.where("amount BETWEEN 10 AND 19")):
        part.coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(files)
    incremental.run_summary_stream(stream, path)
    df.where("amount > 19").coalesce(1).write.mode("append").parquet(files)
    incremental.run_summary_stream(stream, path)  # restarts where it stopped
    incremental.run_summary_stream(stream, path)  # nothing new
    batch = summary.supplier_summary(summary.clean_history(df))
    assert sorted(incremental.merged_summary(spark, path).collect()) == sorted(batch.collect())


def test_compaction_changes_nothing(spark):
    path, files = workspace(spark, "stream"), workspace(spark, "input")
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(summary.supplier_summary(summary.clean_history(df)).collect())
    for part in (df.where("amount < 10"), df.where("amount BETWEEN 10 AND 19"), df.where("amount > 19")):
        part.coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(df.schema).parquet(files)
        incremental.run_summary_stream(stream, path)
        incremental.compact_summary(spark, path)
        incremental.compact_summary(spark, path)  # nothing new
    assert sorted(incremental.merged_summary(spark, path).collect()) == want
    incremental.compact_summary(spark, path)
    assert sorted(incremental.merged_summary(spark, path).collect()) == want


def test_upsert_batches_can_be_repeated(spark):
    path = workspace(spark, "store")
    rows = [("1", "One", "ACTIVO", "HABIDO", "1", "0", None, "s", 1), ("2", "Two", "BAJA", "HABIDO", "1", "1", None, "s", 1)]
    schema = "supplier_key string, legal_name string, key_status string, domicile string, location_code string, irregular string, queried_on string, source string, row int"
    first = enrich.prepare_upsert_source(spark.createDataFrame(rows, schema), None, "row")
    second = first.withColumn("key_status", F.lit("ACTIVO"))
    assert incremental.latest_snapshot(spark, path) is None
    assert incremental.upsert_batch(spark, first, path, 0).first() == (2, 2, 0, 0, 0)
    for _ in range(2):  # a retry of the same batch gives the same version and the same numbers
        assert incremental.upsert_batch(spark, second, path, 1).first() == (2, 0, 1, 1, 1)
    assert incremental.upsert_history(spark, path).count() == 2
    assert incremental.latest_snapshot(spark, path).where("key_status = 'ACTIVO'").count() == 2


def test_one_key_rewrites_one_bucket(spark):
    path = workspace(spark, "store")
    schema = "supplier_key string, legal_name string, key_status string, domicile string, location_code string, irregular string, queried_on string, source string, row int"
    rows = [(str(i), f"Name {i}", "ACTIVO", "HABIDO", "1", "0", None, "s", 1) for i in range(200)]
    every = enrich.prepare_upsert_source(spark.createDataFrame(rows, schema), None, "row")
    assert incremental.upsert_batch(spark, every, path, 0).first() == (200, 200, 0, 0, 0)
    before = incremental.latest_snapshot(spark, path)
    one = every.where("legal_name = 'Name 7'").withColumn("key_status", F.lit("BAJA"))
    assert incremental.upsert_batch(spark, one, path, 1).first() == (1, 0, 1, 0, 1)
    assert len(bucket_store.rewritten_buckets(spark, path, 1)) == 1
    assert len(bucket_store.rewritten_buckets(spark, path, 0)) > 30
    # The same rows again, as the same batch or as a new one, change nothing.
    assert incremental.upsert_batch(spark, one, path, 1).first() == (1, 0, 1, 0, 1)
    assert incremental.upsert_batch(spark, one, path, 2).first() == (1, 0, 0, 1, 2)
    assert bucket_store.rewritten_buckets(spark, path, 2) == []
    assert incremental.upsert_batch(spark, one.limit(0), path, 3).first() == (0, 0, 0, 0, 3)
    now = incremental.latest_snapshot(spark, path)
    assert now.count() == 200 and now.where("key_status = 'BAJA'").count() == 1
    assert now.exceptAll(before).count() == 1


def test_broken_batch_is_not_seen(spark):
    path = workspace(spark, "store")
    schema = "supplier_key string, legal_name string, key_status string, domicile string, location_code string, irregular string, queried_on string, source string, row int"
    one = enrich.prepare_upsert_source(spark.createDataFrame([("1", "One", "ACTIVO", "HABIDO", "1", "0", None, "s", 1)], schema), None, "row")
    incremental.upsert_batch(spark, one, path, 0)
    other = one.withColumn("legal_name", F.lit("Half"))
    other.write.parquet(f"{path}/data/version=1/bucket=0")  # data without a manifest
    assert incremental.latest_snapshot(spark, path).first()["legal_name"] == "One"
    assert incremental.upsert_batch(spark, other, path, 1).first() == (1, 0, 1, 0, 1)
    assert [r["legal_name"] for r in incremental.latest_snapshot(spark, path).collect()] == ["Half"]


def test_merged_sketches_rank_values_as_one_pass_does(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 100_000).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    parts = [df.where(F.pmod(F.col("x"), F.lit(5)) == k) for k in range(-4, 5)]
    sketches = quantiles.quantile_sketches(parts[0], ["x", "none"])
    for part in parts[1:]:
        sketches = sketches.unionByName(quantiles.quantile_sketches(part, ["x", "none"]))
    merged, whole = quantiles.merge_sketches(sketches), quantiles.quantile_sketches(df, ["x", "none"])
    for found in (merged, whole):
        assert [(r["column"], r["rows"]) for r in found.collect()] == [("x", 20_000)]
        for r in quantiles.sketch_quantiles(found, (0.1, 0.5, 0.9)).collect():
            rank = df.where(F.col("x") <= r["value"]).count() / 20_000
            assert abs(rank - r["share"]) <= quantiles.RANK_ERROR


def test_materialize(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert workspace(spark, "t").startswith(f"{shared}/t-")
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(materialize(df, "t").collect()) == sorted(df.collect())
