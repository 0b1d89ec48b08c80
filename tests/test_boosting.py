"""Leaf-wise boosting against a plain version that holds all rows, and on rows it was not fitted on."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.boosting import Model, Settings, bin_cuts, binned_blocks, fit, gradients, score_rows
from ledgerscope.operators.evaluate import ranking_report

FEATURES = ("a", "b", "c", "d")


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.random(), rng.randrange(6), rng.choice([None, rng.gauss(0, 1)])
        hot = (a > 0.6) != (b < 2) or (c is not None and c > 1)
        out.append((i, a, b, c, 1.0, int(rng.random() < (0.8 if hot else 0.15))))
    return out


def plain_tree(bins, g, h, s):
    """Splits the leaf of the largest gain, one after the other, from all its rows."""
    unit = float(1 << 20)

    def best(rows):
        found = None
        tg, th = g[rows].sum() / unit, h[rows].sum() / unit
        for f in range(bins.shape[1]):
            for at in range(1, s.bins + 1):
                left = bins[rows, f] < at
                n = left.sum()
                if n < s.min_rows or len(rows) - n < s.min_rows:
                    continue
                lg, lh = g[rows[left]].sum() / unit, h[rows[left]].sum() / unit
                gain = lg**2 / max(lh + s.l2, 1e-12) + (tg - lg) ** 2 / max(th - lh + s.l2, 1e-12) - tg**2 / max(th + s.l2, 1e-12)
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, at)
        return found

    leaves = [(np.arange(len(bins)), best(np.arange(len(bins))))]
    splits = []
    while len(leaves) < s.leaves and any(b for _, b in leaves):
        k = max((k for k, (_, b) in enumerate(leaves) if b), key=lambda k: leaves[k][1][0])
        rows, (_, f, at) = leaves.pop(k)
        splits.append((f, at, len(rows)))
        left = bins[rows, f] < at
        leaves += [(part, best(part)) for part in (rows[left], rows[~left])]
    value = np.zeros(len(bins))
    for rows, _ in leaves:
        value[rows] = -s.learning_rate * (g[rows].sum() / unit) / max(h[rows].sum() / unit + s.l2, 1e-12)
    return sorted(splits), value


def test_trees_equal_plain_ones(spark):
    rows, s = rows_of(500, 1), Settings(rounds=3, leaves=8, l2=0.5, bins=16, min_rows=10)
    df = spark.createDataFrame(rows, "id long, a double, b int, c double, d double, label int").repartition(5)
    model = fit(df, FEATURES, F.lit(False), s)
    assert len(model.trees) == 3
    bins = np.zeros((500, 4), np.uint8)
    for f in range(4):
        for i, r in enumerate(rows):
            bins[i, f] = 0 if r[f + 1] is None else 1 + sum(c <= r[f + 1] for c in model.cuts[f])
    label = np.array([r[5] for r in rows], float)
    weight = np.where(label == 1, 500 / (2 * label.sum()), 500 / (2 * (500 - label.sum())))
    raw = np.zeros(500)
    for tree in model.trees:
        splits, value = plain_tree(bins, *gradients(raw, label, weight), s)
        node_rows = np.zeros(len(tree.feature), int)
        for leaf, n in zip(*np.unique(tree.nodes(bins), return_counts=True), strict=True):
            node_rows[leaf] = n
        for k in reversed(range(len(tree.feature))):
            if tree.feature[k] >= 0:
                node_rows[k] = node_rows[tree.left[k]] + node_rows[tree.right[k]]
        got = sorted((f, at, n) for f, at, n in zip(tree.feature, tree.at, node_rows.tolist(), strict=True) if f >= 0)
        assert got == splits
        assert np.allclose(tree.raw(bins), value, atol=1e-12)
        raw += tree.raw(bins)
    scores = {r["id"]: r["score"] for r in score_rows(model, df).collect()}
    assert np.allclose([scores[i] for i in range(500)], 1 / (1 + np.exp(-raw)))
    again = fit(df.repartition(2), FEATURES, F.lit(False), s)
    assert again.to_json() == model.to_json() == Model.from_json(model.to_json()).to_json()


def test_held_out_tail_stops_it(spark):
    df = spark.createDataFrame(rows_of(3000, 2), "id long, a double, b int, c double, d double, label int")
    model = fit(df.where("id < 2000"), FEATURES, F.col("id") >= 1700, Settings(rounds=60, learning_rate=0.5, patience=3))
    assert 0 < len(model.trees) < 60
    judged = score_rows(model, df.where("id >= 2000"))
    assert ranking_report(judged).first()["roc_auc"] > 0.7


def test_odd_tables(spark):
    schema = "id long, a double, b int, c double, d double, label int"
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([], schema), FEATURES, F.lit(False))
    same = spark.createDataFrame([(i, None, None, None, None, i % 2) for i in range(50)] + [(99, 1.0, 1, 1.0, 1.0, None)], schema)
    model = fit(same, FEATURES, F.lit(False))
    assert model.trees == []
    assert {r["score"] for r in score_rows(model, same.withColumn("score", F.lit("old"))).collect()} == {0.5}


def test_passes_read_blocks_and_workers_get_text(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(500, 3), "id long, a double, b int, c double, d double, label int").coalesce(1)
    blocks = binned_blocks(df, FEATURES, bin_cuts(df, FEATURES, 8), F.col("label"), F.lit(1.0), F.col("id") % 5 == 0).collect()
    assert len(blocks) == 1
    assert [len(x) for x in blocks[0]] == [500 * 4, 500 * 8, 500 * 8, 500, 500 * 8]
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), send(self, value))[1])
    model = fit(df, FEATURES, F.lit(False), Settings(rounds=2, leaves=4))
    score_rows(model, df).count()
    assert model.to_json() in sent and not any(isinstance(v, Model) for v in sent)
