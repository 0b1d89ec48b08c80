"""Amounts that are too large, odd or finely divided, dates in every layout, and ranks of several columns at once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.temporal import parse_day_first, parse_month_first
from ledgerscope.functions.text import parse_amount
from ledgerscope.operators import profile, ranks, summary
from ledgerscope.operators.history import HistoryColumns, supplier_history
from ledgerscope.sources import links


def test_no_amount_fails_a_job(spark):
    texts = ["100000000000000000", "20123456789012345678901", "0.12345", "-3", "9" * 45, None, "NaN"]
    rows = spark.createDataFrame([(i, "20000000001", t) for i, t in enumerate(texts)], "row_no int, supplier_key string, t string")
    rows = rows.withColumns(
        {
            "amount": F.when(F.col("t") == "NaN", F.lit(float("nan"))).otherwise(parse_amount(F.col("t"))),
            "state": F.lit("Aceptada"),
            "issued_ts": F.timestamp_seconds(F.col("row_no") * 86_400),
            "due_ts": F.timestamp_seconds(F.col("row_no") * 86_400),
            "incident": F.lit(0),
            "invoice_id": F.col("row_no").cast("string"),
        }
    )
    total = summary.supplier_summary(rows).first()
    assert total["amount_count"] == 4  # too long for a sum, and not a number, are left out
    assert total["amount_sum"] == pytest.approx(1e17 + 20123456789012345678901 + 0.12345 - 3)
    history = supplier_history(rows, HistoryColumns(tie_break="row_no")).collect()
    assert len(history) == len(texts)
    after = {r["row_no"]: r for r in history}
    assert after[3]["prev_max_amount"] == pytest.approx(20123456789012345678901)
    issues = {r["rule"]: (r["rows"], r["examples"]) for r in profile.quality_issues(rows, uncountable=True).collect()}
    assert issues["amount_not_countable"] == (2, "4,6")
    assert issues["negative_amount"] == (1, "3")


def test_date_layouts(spark):
    given = {
        "2025-01-02T10:00:00.123": dt.datetime(2025, 1, 2, 10, 0, 0, 123_000),
        "2025-01-02T10:00:00Z": dt.datetime(2025, 1, 2, 10),
        "2025-01-02 10:00:00+05:30": dt.datetime(2025, 1, 2, 4, 30),
        "2025-01-02T10:00:00.5-0500": dt.datetime(2025, 1, 2, 15, 0, 0, 500_000),
        "02/01/25": dt.datetime(2025, 1, 2),
        "02-01-99 08:15": dt.datetime(1999, 1, 2, 8, 15),
        "20250102": dt.datetime(2025, 1, 2),
        "20250102 10:20": dt.datetime(2025, 1, 2, 10, 20),
        "2/1/2025": dt.datetime(2025, 1, 2),
        "2025.01.02": dt.datetime(2025, 1, 2),
        "2025-13-02": None, "31/02/2025": None, "123456": None, "": None, "10:20": None,
    }
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", parse_day_first(F.col("t")).alias("d")).collect()} == given
    assert df.select(parse_month_first(F.lit("02/13/25"))).first()[0] == dt.datetime(2025, 2, 13)


def test_quantiles_of_several_columns(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.random(), 1.0]), float(rng.randint(-5, 5)), None) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    wanted = {"a": (0.0, 0.1, 0.5, 1.0), "b": (0.25, 0.5, 0.75), "c": (0.5,)}
    exact = ranks.exact_quantiles_of(df, wanted)
    assert ranks.exact_quantiles_of(df, wanted, small_rows=0, bins=16) == {c: pytest.approx(v) if c != "c" else v for c, v in exact.items()}
    assert exact["c"] == [None]


def test_links_are_found_by_their_text(spark):
    page = (
        "<a href='/get?id=1&amp;x=2'>Padron <b>reducido.ZIP</b></a><a href='/other'>nothing</a>"
        "<a href='/b.zip'>b</a>" + "<a href='/c'>" + "x" * 50_000 + "</a>"
    )
    pages = spark.createDataFrame([(1, "https://site.test/p/", page), (2, "https://site.test/", "see files/x.zip?y or 'z.ZIP'")], "page_id int, url string, html string")
    got = [(r["page_id"], r["link"]) for r in links.rank_download_links(pages).orderBy("page_id", "link_rank").collect()]
    assert got == [
        (1, "https://site.test/get?id=1&x=2"), (1, "https://site.test/b.zip"), (2, "https://site.test/files/x.zip"), (2, "https://site.test/z.ZIP"),
    ]
