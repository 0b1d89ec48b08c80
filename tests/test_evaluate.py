from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import correlate, evaluate, resample, split


def scored(spark, labels, scores):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores, strict=True)], "label int, score double")


def brute_ranking(labels, scores):
    order = np.unique(scores)[::-1]
    p, n = labels.sum(), (1 - labels).sum()
    ap, last = 0.0, 0.0
    for s in order:
        hit = scores >= s
        recall = labels[hit].sum() / p
        ap += (recall - last) * labels[hit].mean()
        last = recall
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in scores[labels == 1] for b in scores[labels == 0]]
    return ap, sum(pairs) / (p * n)


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_ranking_metrics(spark, digits):
    rng = np.random.default_rng(digits)
    labels = rng.integers(0, 2, 150)
    scores = np.round(np.clip(rng.random(150) * 0.7 + labels * 0.2, 0, 1), digits)
    got = evaluate.ranking_report(scored(spark, labels, scores)).first()
    assert (got["pr_auc"], got["roc_auc"]) == pytest.approx(brute_ranking(labels, scores), abs=1e-12)


def test_sweep_matches_direct_thresholds(spark):
    """Scores that sit exactly on, just below and just above every threshold."""
    grid = np.round(np.arange(0, 1.001, 0.01), 2)
    scores = np.concatenate([grid, np.nextafter(grid, -1), np.nextafter(grid, 2)])
    labels = np.arange(len(scores)) % 2
    sweep = {round(r["threshold"], 2): r for r in evaluate.threshold_sweep(scored(spark, labels, scores)).collect()}
    assert len(sweep) == 91
    for t in np.round(np.arange(0.05, 0.951, 0.01), 2):
        flagged = scores >= t
        row = sweep[float(t)]
        assert row["false_positives"] == int((flagged & (labels == 0)).sum())
        assert row["false_negatives"] == int((~flagged & (labels == 1)).sum())
        assert row["flagged_pct"] == pytest.approx(100 * flagged.mean())


def sweep_rows(spark, rows):
    return spark.createDataFrame(rows, "threshold double, recall double, f1 double, precision double")


def test_threshold_choice(spark):
    eligible = [(0.1, 0.9, 0.4, 0.2), (0.2, 0.7, 0.5, 0.3), (0.3, 0.65, 0.5, 0.4), (0.4, 0.65, 0.5, 0.4), (0.5, 0.5, 0.9, 0.9)]
    best = evaluate.select_threshold(sweep_rows(spark, eligible)).first()
    assert (best["threshold"], best["recall_reached"]) == (0.3, True)
    none = [(0.1, 0.5, 0.4, 0.2), (0.2, 0.3, 0.6, 0.3)]
    best = evaluate.select_threshold(sweep_rows(spark, none)).first()
    assert (best["threshold"], best["recall_reached"]) == (0.2, False)


def test_confusion_edge_cases(spark):
    row = evaluate.confusion_metrics(scored(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (row["precision"], row["recall"], row["f1"], row["mcc"], row["balanced_accuracy"]) == (0.0, 0.0, 0.0, 0.0, 1.0)
    row = evaluate.confusion_metrics(scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.2, 0.1]), 0.5).first()
    assert (row["true_positives"], row["false_positives"], row["accuracy"], row["mcc"]) == (1, 1, 0.5, 0.0)


def test_calibration_and_reliability(spark):
    bins = evaluate.calibration_bins(scored(spark, [0, 0, 1, 1], [0.0, 0.0, 0.0, 1.0])).collect()
    assert sum(r["n"] for r in bins) == 4
    levels = [(0.1, 0.5, 0.5), (0.5, 0.2, 0.5), (0.5, 0.4, 0.5), (0.5, 0.6, 0.5), (0.5, 0.4, 0.1)]
    df = spark.createDataFrame(levels, "pr_auc double, f1 double, precision double")
    got = df.select(evaluate.reliability(F.col("pr_auc"), F.col("f1"), F.col("precision"), 0.1)).collect()
    assert [r[0] for r in got] == ["No confiable", "Limitada", "Aceptable para priorizacion", "Buena", "Limitada"]


@pytest.mark.parametrize("small_rows", [1000, 0])
def test_temporal_split(spark, small_rows):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=i // 3), i % 2) for i in range(20)] + [(20, None, 1), (21, start, None)]
    df = spark.createDataFrame(rows, "row_no bigint, issued_ts timestamp, label int")
    got = split.temporal_split(df, small_rows=small_rows).collect()
    by_split = {s: sorted(r["row_no"] for r in got if r["split"] == s) for s in ("train", "validation", "test")}
    assert by_split == {"train": list(range(12)), "validation": list(range(12, 16)), "test": list(range(16, 20))}
    folds = split.expanding_folds(split.usable_rows(df), small_rows=small_rows).groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in folds} == {0: 5, 1: 5, 2: 5, 3: 5}
    assert split.class_balance(df.limit(0)).first()["ratio"] == 1.0


def test_poisson_weights(spark):
    df = spark.range(20_000).select("id", F.lit(1).cast("bigint").alias("one"), F.lit(40).cast("bigint").alias("many"))
    row = df.agg(
        *[f(resample.poisson_weight(F.col(c), F.col("id"), F.lit(7))) for c in ("one", "many") for f in (F.avg, F.var_pop)]
    ).first()
    assert row[0] == pytest.approx(1, abs=0.04) and row[1] == pytest.approx(1, abs=0.06)
    assert row[2] == pytest.approx(40, abs=0.25) and row[3] == pytest.approx(40, rel=0.05)


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 400)
    scores = np.round(np.clip(rng.random(400) * 0.6 + labels * 0.3, 0, 1), 2)
    df = scored(spark, labels, scores)
    truth = evaluate.confusion_metrics(df, 0.5).first().asDict() | evaluate.ranking_report(df).first().asDict()
    first, again = (resample.bootstrap_ci(df.repartition(n), 0.5, rounds=60).collect() for n in (1, 7))
    for row, other in zip(first, again, strict=True):  # repeatable, however the rows are partitioned
        assert (row["low"], row["high"]) == pytest.approx((other["low"], other["high"]), abs=1e-9)
        assert row["low"] < truth[row["metric"]] < row["high"]
        assert row["high"] - row["low"] < 0.25


def test_permuted_rows(spark):
    df = spark.createDataFrame([(i, i * 10, f"c{i}") for i in range(30)], "row_no bigint, a int, b string")
    got = resample.permuted_rows(df, ["a", "b"], repeats=2)
    assert got.count() == 30 * 4
    for repeat in (0, 1):
        part = got.where((F.col("feature") == "a") & (F.col("repeat") == repeat)).collect()
        assert sorted(r["a"] for r in part) == [i * 10 for i in range(30)]
        assert any(r["a"] != r["row_no"] * 10 for r in part)
        assert all(r["b"] == f"c{r['row_no']}" for r in part)


def test_correlations(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    rows = [(int(t), float(t) + float(rng.normal()), None if i % 9 == 0 else "ab"[int(rng.integers(0, 2))], 1.0) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "incident int, x double, c string, constant double")
    got = {r["variable"]: r["correlation"] for r in correlate.target_correlations(df, ["x", "constant"], ["c"]).collect()}
    assert set(got) == {"x", "c_a", "c_b", "c_nan"}
    assert got["x"] == pytest.approx(np.corrcoef(y, [r[1] for r in rows])[0, 1])
    for level, name in ((None, "nan"), ("a", "a")):
        assert got[f"c_{name}"] == pytest.approx(np.corrcoef(y, [r[2] == level for r in rows])[0, 1])
    matrix = {(r[0], r[1]): r[2] for r in correlate.correlation_matrix(df, ["x", "constant"], ["c"], top=3).collect()}
    assert len(matrix) == 6 and matrix[("incident", "x")] == pytest.approx(got["x"])
