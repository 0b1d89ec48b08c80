"""The near-copy stage of the pipeline against all pairs, on built texts."""

from __future__ import annotations

import random

from plans import joins_over
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm.near_text import _by_prefix, near_text_dedup, near_text_labels


def grams(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a: str, b: str) -> float:
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(words: list[str], edits: int, rng: random.Random) -> str:
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_of_the_stage_rule_go_and_no_others(spark):
    rng = random.Random(3)
    texts: list[str] = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 300))]
        texts += [" ".join(words), edited(words, 2, rng), edited(words, 4, rng), edited(words, 12, rng)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {find(i) for i in range(len(texts))}
    assert len(pairs) > 40 and 40 <= len(want) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def test_crowd_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [edited(words, 3, rng) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_text_labels(docs).collect()} == {0}


def labels_of(texts: list[str]) -> list[int]:
    """The smallest number of each component, by all pairs."""
    root = list(range(len(texts)))
    sets = [grams(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_crowd_with_members_of_all_distances(spark):
    """Copies of one text with 0 to 30 edits, and texts that share a passage: buckets stay mixed and crowded."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(base, rng.choice([0, 1, 2, 3, 3, 4, 4, 5, 6, 8, 12, 30]), rng) for _ in range(300)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"q{rng.randrange(10**7)}" for _ in range(60)]) for _ in range(100)]
    want = labels_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_text_labels(docs).collect()}
    assert len(set(want)) > 150
    assert [got[i] for i in range(len(texts))] == want


def test_prefixes_find_every_similar_pair(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [edited(base[: rng.randint(66, 80)], rng.randint(0, 3), rng) for _ in range(150)]
    sets = [{hash(g) % 2**31 for g in grams(t)} for t in texts]
    rows = [(i, i % 7, sorted(x)) for i, x in enumerate(sets)]
    crowd = spark.createDataFrame(rows, "node long, root long, items array<int>")
    got = {(r["u"], r["v"]) for r in _by_prefix(crowd).collect()}
    similar = {
        (a, b) for a in range(150) for b in range(a + 1, 150)
        if a % 7 != b % 7 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    assert len(similar) > 500 and similar <= got


def test_names_of_columns_do_no_harm(spark):
    clashes = "node n key keys root size pivot u v id row fp items s a b".split()
    docs = spark.createDataFrame([(1, "some words here"), (2, "some  words here"), (3, "x")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("old") for c in clashes})
    assert {r["doc_id"] for r in near_text_dedup(docs).collect()} == {1, 3}
    named = docs.drop("node").withColumnRenamed("doc_id", "node").withColumnRenamed("text", "key2")
    assert {r["node"] for r in near_text_dedup(named, "node", "key2").collect()} == {1, 3}


def test_odd_texts_and_ids(spark):
    rows = [(9, ""), (4, None), (7, " \n"), (1, "some words"), (3, "Some  words"), (None, "alone"), (2, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_text_dedup(docs)
    assert {r["doc_id"] for r in kept.collect()} == {4, 1, None, 2}
    assert near_text_dedup(docs.limit(0)).count() == 0
    assert near_text_dedup(docs.withColumn("component_id", F.lit(1)).union(docs.withColumn("component_id", F.lit(1)))).count() == 8


def test_entries_of_prefixes_are_not_sent_to_every_executor(spark):
    """Every entry asks for several classes of sizes; the file it comes from is far smaller."""
    crowd = spark.createDataFrame([(i, i % 7, list(range(i, i + 40))) for i in range(60)], "node long, root long, items array<int>")
    pairs = _by_prefix(crowd)
    assert joins_over(pairs, "Generate") == {"SortMergeJoin"}
    assert pairs.count() > 0
