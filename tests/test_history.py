from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest

from ledgerscope import schema as S
from ledgerscope.operators.history import daily_prior, leakage_report, supplier_history

SCHEMA = "supplier_key string, issued_ts timestamp, row_no bigint, amount double, incident int"
START = dt.datetime(2024, 1, 1)


def random_rows(seed, n=260, intraday=False, keys=("A", "B", "C", None)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = None if rng.random() < 0.07 else START + dt.timedelta(days=rng.randrange(180))
        if ts and intraday:
            ts += dt.timedelta(hours=rng.randrange(24), microseconds=rng.randrange(3))
        amount = None if rng.random() < 0.05 else round(rng.uniform(-50, 500), 2)
        # One supplier owns most rows.
        key = rng.choices(keys, weights=[10, 2, 1, 3][: len(keys)])[0]
        rows.append((key, ts, i * 3 + 1, amount, rng.choice([0, 1, None])))
    rng.shuffle(rows)
    return rows


def brute_force(rows):
    amounts = [r[3] for r in rows if r[3] is not None]
    median = statistics.median(amounts)
    by_day = defaultdict(lambda: [0, 0])
    for _, ts, _, _, y in rows:
        if ts is not None and y is not None:
            by_day[ts.date()][0] += y
            by_day[ts.date()][1] += 1
        elif ts is not None:
            by_day[ts.date()]

    def prior(day):
        days = sorted(by_day)
        day = day if day is not None else (days[-1] if days else None)
        s = sum(by_day[d][0] for d in days if d < day)
        k = sum(by_day[d][1] for d in days if d < day)
        return s / k if k else 0.0

    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for group in groups.values():
        group.sort(key=lambda r: (r[1] is None, r[1] or START, r[2]))
        for i, (_, ts, tie, amount, _) in enumerate(group):
            past = group[:i]
            known = [r[4] for r in past if r[4] is not None]
            paid = [r[3] for r in past if r[3] is not None]
            mean = sum(paid) / len(paid) if paid else median
            gap = (ts - past[-1][1]).days if past and ts and past[-1][1] else 9999
            recent = {n: [r for r in past if ts and r[1] and r[1] >= ts - dt.timedelta(days=n)] for n in (30, 90)}
            out[tie] = {
                "prev_count": i,
                "prev_incidents": sum(known),
                "prev_incident_rate": (sum(known) + prior(ts.date() if ts else None) * 5) / (len(known) + 5),
                "prev_mean_amount": mean,
                "prev_max_amount": max(paid) if paid else median,
                "days_since_prev": gap,
                "incidents_30d": sum(r[4] or 0 for r in recent[30]),
                "incidents_90d": sum(r[4] or 0 for r in recent[90]),
                "invoices_30d": len(recent[30]),
                "invoices_90d": len(recent[90]),
                "amount_deviation": 0.0 if amount is None else amount - mean,
                "is_new_supplier": int(i == 0),
            }
    return out


def features(df, **options):
    table = supplier_history(df, **options)
    return {r["row_no"]: {f: r[f] for f in S.HISTORY_FEATURES} for r in table.collect()}


@pytest.mark.parametrize("intraday", [False, True])
@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 5])
def test_agrees_with_brute_force(spark, intraday, hot_rows):
    rows = random_rows(7 + hot_rows, intraday=intraday)
    got = features(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows)
    want = brute_force(rows)
    assert got.keys() == want.keys()
    for tie, expected in want.items():
        assert got[tie] == pytest.approx(expected, abs=1e-9), tie


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_one_supplier_on_one_day(spark, hot_rows):
    """The worst skew: every row has the same key and the same issue time."""
    rows = [("A", START, i, float(i), i % 2) for i in range(120)]
    got = features(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows)
    want = brute_force(rows)
    for tie, expected in want.items():
        assert got[tie] == pytest.approx(expected, abs=1e-9), tie


def test_partitioning_and_input_order_do_not_matter(spark):
    rows = random_rows(3)
    one = features(spark.createDataFrame(rows, SCHEMA).repartition(1))
    many = features(spark.createDataFrame(rows[::-1], SCHEMA).repartition(8, "amount"))
    assert one == many


def test_own_and_future_targets_do_not_leak(spark):
    rows = random_rows(11)
    before = features(spark.createDataFrame(rows, SCHEMA))
    cut = START + dt.timedelta(days=90)
    flipped = [(k, t, o, a, 1 - y if y is not None and (t is None or t >= cut) else y) for k, t, o, a, y in rows]
    after = features(spark.createDataFrame(flipped, SCHEMA))
    early = [o for k, t, o, a, y in rows if t is not None and t < cut]
    assert early and all(before[o] == after[o] for o in early)
    one = next(r for r in rows if r[1] is not None and r[4] is not None)
    changed = [(*r[:4], 1 - r[4]) if r is one else r for r in rows]
    assert features(spark.createDataFrame(changed, SCHEMA))[one[2]] == before[one[2]]


def test_past_fill_does_not_see_future_amounts(spark):
    rows = random_rows(5)
    cut = START + dt.timedelta(days=90)
    later = [(k, t, o, a * 10 if a is not None and (t is None or t >= cut) else a, y) for k, t, o, a, y in rows]
    early = [o for k, t, o, a, y in rows if t is not None and t < cut]
    past = [features(spark.createDataFrame(r, SCHEMA), fill="past_mean") for r in (rows, later)]
    assert all(past[0][o] == past[1][o] for o in early)
    median = [features(spark.createDataFrame(r, SCHEMA)) for r in (rows, later)]
    assert any(median[0][o] != median[1][o] for o in early)  # the agreed default does see them


def test_no_dates_and_no_targets(spark):
    rows = [("A", None, 1, 5.0, None), ("A", None, 2, 7.0, None), (None, None, 3, None, None)]
    got = features(spark.createDataFrame(rows, SCHEMA))
    assert got[2]["prev_count"] == 1 and got[2]["prev_mean_amount"] == 5.0 and got[2]["prev_incident_rate"] == 0.0
    assert got[3]["prev_mean_amount"] == 6.0 and got[3]["days_since_prev"] == 9999


def test_prior_and_report(spark):
    rows = [("A", START, 1, 1.0, 1), ("B", START, 2, 1.0, 0), ("A", START + dt.timedelta(days=1), 3, 1.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    prior = {r["day"]: r["prior_rate"] for r in daily_prior(df).collect()}
    assert prior == {START.date(): 0.0, (START + dt.timedelta(days=1)).date(): 0.5, None: 0.5}
    assert leakage_report(supplier_history(df)).first().asDict() == {
        "rows": 3, "global_rate": pytest.approx(2 / 3), "new_supplier_rows": 2,
    }


def test_missing_columns_and_options(spark):
    df = spark.createDataFrame([("A",)], "supplier_key string")
    with pytest.raises(ValueError, match="missing columns amount, incident, issued_ts, row_no"):
        supplier_history(df)
    with pytest.raises(ValueError, match="unknown fill"):
        supplier_history(spark.createDataFrame([], SCHEMA), fill="zero")


def test_history_reads_only_its_columns(spark):
    """The window shuffle happens once, on the supplier."""
    plan = supplier_history(spark.createDataFrame(random_rows(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_key") == 1
