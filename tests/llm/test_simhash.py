"""Fingerprints, pairs and components against brute force."""

from __future__ import annotations

import random
import re

import xxhash
from plans import joins_over
from pyspark.sql import functions as F

from ledgerscope.llm.components import _with_smallest, components
from ledgerscope.llm.simhash import fingerprint, near_pairs, op3_simhash_near_dedup, simhash

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text: str) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids: dict[int, list[int]]) -> dict[int, int]:
    """For each fingerprint the smallest id reachable."""
    prints, label = sorted(ids), {}
    for start in prints:
        if start in label:
            continue
        group, todo = {start}, [start]
        while todo:
            u = todo.pop()
            for v in prints:
                if v not in group and (u ^ v).bit_count() <= 3:
                    group.add(v)
                    todo.append(v)
        least = min(min(ids[v]) for v in group)
        label |= dict.fromkeys(group, least)
    return label


def test_fingerprints():
    for text in ("", " \n", "one", "One two", "a b c d", "É é A a " * 50, "x y " * 70_000, "A\x0bB\x1cC d"):
        assert fingerprint(text) == plain_fingerprint(text)


def test_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    ids: dict[int, list[int]] = {}
    for r in docs:
        ids.setdefault(plain_fingerprint(r["text"] or ""), []).append(r["doc_id"])
    label = plain_components(ids)
    want = {(i, f"{fp:016x}", label[fp]) for fp, members in ids.items() for i in members}
    assert {tuple(r) for r in op3_simhash_near_dedup(spark, SF_DIR).collect()} == want


def crowd(n: int, seed: int) -> list[int]:
    """Fingerprints around a few centres, so that many share a half."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    out = set(centres)
    while len(out) < n:
        fp = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randrange(64)
        out.add(fp)
    return [fp - (1 << 64) if fp >> 63 else fp for fp in out]


def test_pairs_are_complete_with_and_without_crowded_halves(spark):
    prints = crowd(400, 5)
    want = {(u, v) for u in prints for v in prints if u < v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 3}
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (1_000_000, 20, 1):
        assert {tuple(r) for r in near_pairs(table, bucket=bucket).collect()} == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (1, 0), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = dict.fromkeys(range(201), 0) | dict.fromkeys(range(1000, 1301), 1000) | {5000: 5000}
    assert got == want


def test_texts_without_words_are_linked(spark):
    docs = spark.createDataFrame([(9, ""), (4, None), (7, " \n"), (1, "some words that stand alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash(docs).collect()}
    assert got == {9: 4, 4: 4, 7: 4, 1: 1}


def test_many_copies_of_one_text(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.md5(F.col("id").cast("string"))).alias("text")
    )
    got = simhash(docs).where("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_exploded_sides_are_not_sent_to_every_executor(spark, tmp_path):
    """A small file of fingerprints is many times as large once its keys are exploded, so the join must not broadcast it."""
    spark.createDataFrame([(v,) for v in crowd(600, 1)], "fp long").write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    for pairs in (near_pairs(prints, bucket=10**6), near_pairs(prints, bucket=100)):
        assert "SortMergeJoin" in joins_over(pairs, "Generate")
        assert "BroadcastHashJoin" not in joins_over(pairs, "Generate")
    edges = prints.select(F.col("fp").alias("u"), (F.col("fp") - 1).alias("v"))
    assert joins_over(_with_smallest(edges), "Generate") == {"SortMergeJoin"}
