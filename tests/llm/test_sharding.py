"""Laws of the hash tree."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerscope.llm.sharding import TREE, Node, count_shards, grow, op7_sharding, place, shard, uniform_tree

SF_DIR = "/root/testdata/sf0.01"


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op7_sharding(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    slots: dict[int, list[int]] = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_slices_and_repeated_ids(spark):
    docs = spark.range(600).select((F.col("id") % 150).alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = shard(docs, uniform_tree(2, 2, 2), rows_per_slice=10).collect()
    by_id: dict[int, set[int]] = {}
    slots: dict[int, list[int]] = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_id.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_movement_is_confined(spark):
    def tree(w: float) -> Node:
        racks = (Node("a", (Node("a0", shard=0), Node("a1", leaf_weight=w, shard=1))), Node("b", (Node("b0", shard=2), Node("b1", shard=3))))
        return Node("", (Node("r0", racks), Node("r1", (Node("c", (Node("c0", leaf_weight=4.0, shard=4),)),))))

    keys = spark.range(20_000).select(place(F.col("id"), tree(1.0)).alias("x"), place(F.col("id"), tree(3.0)).alias("y")).collect()
    count = Counter(r["x"] for r in keys)
    assert abs(count[4] - 10_000) < 400 and all(abs(count[s] - 2_500) < 250 for s in range(4))
    moved = [r for r in keys if r["x"] != r["y"]]
    assert moved and all(r["y"] in (0, 1, 2, 3) for r in moved if r["x"] == 4)  # only into the heavier region
    assert not [r for r in moved if r["x"] == 1]  # nothing leaves the heavier shard
    assert not [r for r in moved if r["y"] == 4]


def test_growth(spark):
    grown = grow(TREE)
    assert (count_shards(TREE), count_shards(grown)) == (40, 41)
    keys = spark.range(41_000).select(place(F.col("id"), TREE).alias("x"), place(F.col("id"), grown).alias("y")).collect()
    moved = [r for r in keys if r["x"] != r["y"]]
    assert {r["y"] for r in moved} == {40} and abs(len(moved) - 1000) < 150
