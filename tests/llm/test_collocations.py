"""Frequent phrases against a plain count, and the summaries against their guarantee."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.collocations import Summary, collocations, frequent_sequences


def plain_counts(rows):
    counts, totals = collections.Counter(), collections.Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    return counts, totals


def plain_collocations(rows, threshold, top=2000):
    counts, totals = plain_counts(rows)
    phrases = {p: a for p, a in counts.items() if len(p) > 2 and a >= threshold}
    covered = collections.defaultdict(int)
    for (lang, *words), a in phrases.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                inner = (lang, *words[i : i + n])
                covered[inner] = max(covered[inner], a)
    out = collections.defaultdict(list)
    for (lang, *words), a in phrases.items():
        if 100 * covered[(lang, *words)] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["New", "york", "CITY", "the", "of", "a", "b", "état", "x y", "#"]
    marks = [" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "; "]
    texts = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    return [*texts, ("en", None), (None, ""), ("fr", " . , "), ("en", "a " * 5000)]


def test_phrases_against_plain_count(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = plain_collocations(rows, 12)
    assert len(want) > 100
    assert {tuple(r) for r in collocations(docs, threshold=12).collect()} == want
    # Summaries with few counters, and survivors that are too many to be sent, change nothing.
    assert {tuple(r) for r in collocations(docs, threshold=12, counters=4, shipped=3).collect()} == want
    first = {tuple(r) for r in collocations(docs, threshold=12, top=5).collect()}
    assert first == {w for w in want if w[1] <= 5}


def test_every_frequent_sequence_survives(spark, rows):
    counts, totals = plain_counts(rows)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r["lang"], r["words"], r["phrase"]): r["n"] for r in frequent_sequences(docs, threshold=7, counters=2).collect()}
    want = {(p[0], len(p) - 1, " ".join(p[1:])): a for p, a in counts.items() if a >= 7}
    want |= {(lang, 0, ""): n for lang, n in totals.items() if n}
    assert got == want


def test_summary_bounds_its_error():
    rng = np.random.default_rng(4)
    stream = np.concatenate((rng.integers(0, 50_000, 60_000), rng.integers(0, 40, 2_000)))
    rng.shuffle(stream)
    true = collections.Counter(stream.tolist())
    summary = Summary(30, counters=16)
    for part in np.array_split(stream, 100):
        keys, counts = np.unique(part, return_counts=True)
        summary.merge(keys.astype(np.uint32), counts)
        summary.settle()
        assert len(summary.keys) <= summary.capacity
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert 0 < summary.cut < 30 and summary.capacity < len(true)
    assert all(a - summary.cut <= left.get(k, 0) <= a for k, a in true.items())
    assert {k for k, a in true.items() if a >= 30} <= set(summary.survivors().tolist())


def test_odd_rows(spark, messy, nothing):
    got = {(r["lang"], r["phrase"]) for r in collocations(messy.withColumn("phrase", F.lit(1)), threshold=3).collect()}
    assert ("en", "and more words here") in got and ("de", "wörter wörter") not in got
    assert collocations(nothing).count() == 0
