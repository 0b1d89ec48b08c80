from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from ledgerscope.operators.skew import BITS_PER_KEY, maybe_listed, semi_join_keys
from ledgerscope.sources import by_time

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Days in disorder, a third of the rows on one day, some without a time."""
    made = [(i, None if i % 50 == 7 else START + timedelta(days=100 if i % 3 == 0 else i * 37 % 365)) for i in range(900)]
    return spark.createDataFrame(made, "row_no bigint, issued_ts timestamp"), made


def ids(df):
    return sorted(r["row_no"] for r in df.collect())


def test_only_files_of_the_time_are_opened(spark, rows, tmp_path):
    df, made = rows
    path = str(tmp_path / "by time")
    by_time.write_by_time(df, path, files=12)
    files = by_time.time_files(spark, path)
    assert files.agg({"rows": "sum"}).first()[0] == 900 and files.count() > 6
    for low, high in ((None, None), (300, None), (None, 40), (100, 101), (120, 180), (500, None)):
        start, end = (None if d is None else START + timedelta(days=d) for d in (low, high))
        fits = [i for i, t in made if t is not None and (start is None or t >= start) and (end is None or t < end)]
        found = by_time.read_between(spark, path, start, end)
        assert ids(found) == fits
        if low in (300, 500) or high == 40:
            assert len(found.inputFiles()) < files.count() / 2
        with_null = by_time.read_between(spark, path, start, end, untimed=True)
        assert ids(with_null) == sorted(fits + [i for i, t in made if t is None])


def test_versions_and_empty(spark, rows, tmp_path):
    df, _ = rows
    path = str(tmp_path / "versions")
    with pytest.raises(ValueError, match="nothing written"):
        by_time.read_between(spark, path)
    by_time.write_by_time(df, path, rows_per_file=100)
    # Files without their row in the table of files are not there for a reader.
    df.where("row_no < 10").write.parquet(f"{path}/data-half")
    assert by_time.read_between(spark, path, untimed=True).count() == 900
    by_time.write_by_time(df.where("row_no < 10"), path)
    assert ids(by_time.read_between(spark, path, untimed=True)) == list(range(10))
    by_time.write_by_time(df.limit(0), path)
    assert by_time.read_between(spark, path).columns == df.columns and by_time.read_between(spark, path).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_bit_map_keeps_every_listed_key(spark, kind):
    keys = spark.range(3000).selectExpr(f"CAST(id * 7 AS {kind}) AS k").union(spark.sql(f"SELECT CAST(NULL AS {kind})"))
    rows = spark.range(21000).selectExpr(f"CAST(id AS {kind}) AS k", "id AS row_no")
    kept = maybe_listed(rows, keys, "k")
    assert kept.columns == rows.columns
    assert kept.join(keys, "k", "left_semi").count() == 3000
    assert kept.count() < 3000 + 18000 * 2 / BITS_PER_KEY
    assert semi_join_keys(rows, keys, "k", small=False).count() == 3000
    assert semi_join_keys(rows, keys, "k", small=False, how="left_anti").count() == 18000
    assert semi_join_keys(rows, keys.limit(0), "k", small=False).count() == 0


def test_no_bit_map_where_it_cannot_serve(spark):
    keys, rows = spark.range(100_000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    assert maybe_listed(rows, keys, "k", max_bytes=4096) is rows
    assert maybe_listed(rows.selectExpr("CAST(k AS int) AS k"), keys, "k").count() == 10
    assert semi_join_keys(rows.selectExpr("CAST(k AS int) AS k"), keys, "k", small=False).count() == 10
