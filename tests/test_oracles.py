"""Every query with an oracle agrees with it; the others return rows."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()
# Trained on every run; covered on small data by test_learn.py.
TRAINED = {
    "preprocessed", "model_scores", "time_series_search", "experiment_metrics", "calibrated_scores", "final_metrics",
    "permutation_importance", "scored_pending",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_oracle(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES) - TRAINED))
def test_query_without_oracle_returns_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(queries())
