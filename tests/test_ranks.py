from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import ranks
from ledgerscope.operators.skew import hot_keys, join_many_to_one, semi_join_keys


@pytest.mark.parametrize("bins", [4, 64])
@pytest.mark.parametrize("kind", ["spread", "ties", "outlier", "single"])
def test_exact_quantiles(spark, kind, bins):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.normal(size=501),
        "ties": rng.integers(0, 4, 300).astype(float),
        "outlier": np.append(rng.random(200), [1e300, -1e12]),
        "single": np.array([3.5]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = (0.0, 0.1, 0.33, 0.5, 0.85, 1.0)
    want = np.quantile(values, shares)
    for small_rows in (1_000_000, 0):
        got = ranks.exact_quantiles(df, "v", shares, small_rows=small_rows, bins=bins)
        assert got == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert ranks.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("small_rows", [1_000, 0])
def test_rows_at_ranks(spark, small_rows):
    rng = np.random.default_rng(2)
    rows = sorted((int(a), i) for i, a in enumerate(rng.integers(0, 9, 200)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    wanted = [0, 57, 160, 199, 200]
    got = ranks.rows_at_ranks(df, "a", "b", wanted, small_rows)
    assert got == [rows[r] if r < 200 else None for r in wanted]


@pytest.mark.parametrize("slices", [1, 3, 50])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, slices, descending):
    rng = np.random.default_rng(3)
    values = np.unique(rng.random(150) ** 8)  # dense near zero
    rows = [(g, float(v), int(n)) for g in "xy" for v, n in zip(values, rng.integers(0, 5, len(values)), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    table = ranks.running_totals(df, "v", {"t": F.col("n")}, within=["g"], descending=descending, slices=slices)
    for group in "xy":
        ordered = sorted([r[1:] for r in rows if r[0] == group], reverse=descending)
        want = dict(zip([v for v, _ in ordered], np.cumsum([n for _, n in ordered]), strict=True))
        got = {r["v"]: r["t"] for r in table.where(F.col("g") == group).collect()}
        assert got == want


def test_hot_keys_and_joins(spark):
    facts = [("hot", i) for i in range(60)] + [(None, 100 + i) for i in range(50)] + [("a", 1000), ("gone", 1001)]
    df = spark.createDataFrame(facts, "k string, i int")
    assert hot_keys(df, "k", 20).rows == {"hot": 60, None: 50}
    assert hot_keys(df, "k", 20, limit=1).rows == {"hot": 60}
    dim = spark.createDataFrame([("hot", "H"), ("a", "A"), ("unused", "U")], "k string, name string")
    names = {"hot": "H", "a": "A"}
    for options in ({}, {"broadcast_rows": 0, "hot_rows": 20}, {"broadcast_rows": 0}, {"small": True}):
        for how in ("left", "inner"):
            got = sorted((r["i"], r["name"]) for r in join_many_to_one(df, dim, "k", how=how, **options).collect())
            want = sorted((i, names.get(k)) for k, i in facts if how == "left" or k in names)
            assert got == want, (options, how)
    for rows in (0, 10):
        kept = semi_join_keys(df, dim, "k", broadcast_rows=rows)
        assert kept.count() == 61
        assert semi_join_keys(df, dim, "k", how="left_anti", broadcast_rows=rows).count() == 51


def test_semi_join_with_hot_and_null_keys(spark):
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else "cold" if i % 4 else f"k{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string")
    keys = spark.createDataFrame([("hot",), ("k1",), ("k6",), ("k6",), (None,)], "k string")
    listed = {"hot", "k1", "k6"}
    for hot_rows in (1, 100, 1_000_000):
        kept = semi_join_keys(df, keys, "k", broadcast_rows=0, hot_rows=hot_rows)
        gone = semi_join_keys(df, keys, "k", how="left_anti", broadcast_rows=0, hot_rows=hot_rows)
        assert {r["i"] for r in kept.collect()} == {i for i, k in rows if k in listed}
        assert sorted(r["i"] for r in gone.collect()) == [i for i, k in rows if k not in listed]


def test_brackets_start_small_and_many_columns_do_not_meet_in_one_task(spark, monkeypatch):
    df = spark.range(0, 60_000, 1, 4).select(F.xxhash64("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    want = {c: [v] for c, v in zip("ab", df.agg(F.percentile("a", 0.5), F.percentile("b", 0.5)).first(), strict=True)}
    sizes = []
    bin_of = ranks._Bracket.bin_of
    monkeypatch.setattr(ranks._Bracket, "bin_of", lambda self, bins: (sizes.append(self.rows), bin_of(self, bins))[1])
    monkeypatch.setattr(ranks, "SMALL_VALUES", 100_000)
    assert ranks.exact_quantiles_of(df, {"a": (0.5,), "b": (0.5,)}) == want
    assert sizes and max(sizes) < 600
