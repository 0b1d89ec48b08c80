"""Runs of words against all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerscope.llm.periodic_runs import Wavelet, collapsed, find_runs, op13_periodic_runs, periodic_runs, planted

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, repeats * q):
                part = words[i : i + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def found(words):
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return [tuple(r) for r in find_runs(np.array([number[w] for w in words], np.int64)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_all_runs_of_few_symbols(words):
    assert found(words) == plain_runs(words)


def test_all_runs_of_planted_periods():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(20, 300)
        words = [rng.randrange(50) for _ in range(n)]
        at, q = rng.randrange(n - 10), rng.randint(1, n // 5)
        words = words[:at] + [words[at + k % q] for k in range(n - at)] if at + q <= n else words
        words[rng.randrange(n)] = 99
        assert found(words) == plain_runs(words)


def test_nested_and_long_runs():
    inner = ["a"] * 8 + ["b"]
    words = inner * 6 + ["c", "d"] * 500
    assert found(words) == plain_runs(words)
    assert found(["x"] * 20_000) == [(0, 20_000, 1)]
    assert found([str(i) for i in range(5000)]) == []


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(200)
    tree = Wavelet(values)
    for _ in range(200):
        a, b = sorted(rng.integers(0, 201, 2))
        if a == b:
            continue
        x, part = int(values[rng.integers(0, 200)]), np.sort(values[a:b])
        low, high = np.array([a]), np.array([b])
        assert tree.smaller(low, high, np.array([x]))[0] == (part < x).sum()
        k = int(rng.integers(0, b - a))
        assert tree.ranked(low, high, np.array([k]))[0] == part[k]


def test_collapsed_keeps_the_first_period():
    words = "a b a b a b a b c".split()
    assert collapsed(words, np.array([[0, 8, 2]])) == "a b c"
    assert collapsed([], np.empty((0, 3), np.int64)) == ""


def test_query_against_plain_version(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = plain_planted(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        if len(words) > 1500:
            continue  # the plain search takes the square of the length
        runs, g = plain_runs(words), got[r["doc_id"]]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        some += bool(runs)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (g["n_runs"], g["start"], g["length"], g["period"]) == (len(runs), *best)
        assert g["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        assert g["runs_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert g["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 5


def test_ids_without_number():
    assert planted(None, ["a"]) == ["a"]


def test_two_periods_are_refused(spark, messy):
    with pytest.raises(ValueError):
        periodic_runs(messy, repeats=2)


def test_odd_rows(messy, nothing):
    clashing = messy.withColumnRenamed("kept", "runs").withColumnRenamed("size", "Collapsed")
    got = periodic_runs(clashing)
    assert [c.lower() for c in got.columns].count("collapsed") == 1 and "lang" in got.columns
    rows = got.collect()
    assert len(rows) == messy.count() and periodic_runs(nothing).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert (by[4]["runs"], by[4]["collapsed"]) == ([], "")
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 20_000, 1)] and by[6]["collapsed"] == "wörter"
