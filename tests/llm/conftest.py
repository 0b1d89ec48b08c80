from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge_rows import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(ROWS, schema)
    clashes = (
        "n_chars kept keep_id group_size text_sha256 spans shard slot size law n_lines kept_text ids decoded n_tokens copies "
        "domain leaf_budget fingerprint component_id n_words clean_text host path rule verdict Kept _row"
    ).split()
    seen, names = set(), []
    for c in clashes:
        if c.lower() not in seen:
            seen.add(c.lower())
            names.append(c)
    return docs.withColumns({c: F.lit(f"old {c}") for c in names})


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
