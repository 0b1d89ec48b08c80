"""Ordered category statistics with hot categories cut into slices, against a plain walk along the drawn order."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators.category_stats import category_totals, ordered_category_stats, with_category_shares

SCHEMA = "row_no long, kind string, place string, label int"


def rows_of(n):
    rng = random.Random(3)
    return [(i, rng.choice(["hot"] * 4 + ["a", "b", None]), rng.choice("xyz"), int(rng.random() < 0.3)) for i in range(n)]


def plain(rows):
    share = sum(r[3] for r in rows) / len(rows)
    place = {r[0]: int(hashlib.md5(f"{S.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) for r in rows}
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: (place[r[0]], r[0])):
        for feature, level in (("kind", r[1] or S.MISSING_CATEGORY), ("place", r[2])):
            n, p = seen.get((feature, level), (0, 0))
            out[(r[0], feature, level)] = (n, (p + share) / (n + 1))
            seen[(feature, level)] = (n + 1, p + r[3])
    return out


@pytest.mark.parametrize("slice_rows", [200_000, 40])
def test_shares_of_the_rows_before(spark, slice_rows):
    rows = rows_of(600)
    found = ordered_category_stats(spark.createDataFrame(rows, SCHEMA), ["kind", "place"], slice_rows=slice_rows)
    got = {(r["row_no"], r["feature"], r["level"]): (r["rows_before"], r["value"]) for r in found.collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_other_rows_take_the_totals(spark):
    df = spark.createDataFrame(rows_of(200), SCHEMA)
    new = spark.createDataFrame([(900, "a", "x", None), (901, "unseen", None, None)], SCHEMA)
    train, other = with_category_shares(df, [new], ["kind", "place"])
    assert train.count() == 200 and train.where("kind_share IS NULL").count() == 0
    totals, share = category_totals(df, ["kind"])
    a = totals.where("level = 'a'").first()["value"]
    got = {r["row_no"]: (r["kind_share"], r["place_share"]) for r in other.collect()}
    assert got[900][0] == a and got[901] == (share, share)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ordered_category_stats(empty, ["kind"]).count() == 0
    assert with_category_shares(empty, [empty.withColumn("more", F.lit(1))], ["kind"])[1].columns[-2:] == ["more", "kind_share"]
