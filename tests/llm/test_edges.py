"""Every operator on rows with nulls, repeats, long texts and clashing names, and on an empty table."""

from __future__ import annotations

import hashlib

import pytest
from edge_rows import ROWS
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm.bpe import encode, encode_decode
from ledgerscope.llm.exact_dedup import drop_copies, exact_dedup
from ledgerscope.llm.html_extract import extract_main_text
from ledgerscope.llm.line_dedup import line_dedup
from ledgerscope.llm.mixing import mix, mixed_documents
from ledgerscope.llm.quality import quality
from ledgerscope.llm.secret_scan import scan_secrets
from ledgerscope.llm.sharding import TREE, shard
from ledgerscope.llm.simhash import near_dedup, simhash
from ledgerscope.llm.url_filter import filter_urls

ONE_ROW_EACH = {
    "bpe": encode, "bpe_decoded": encode_decode, "exact": exact_dedup, "lines": line_dedup, "quality": quality,
    "secrets": scan_secrets, "shard": lambda d: shard(d, TREE), "simhash": simhash,
    "html": lambda d: extract_main_text(d, "text"), "urls": lambda d: filter_urls(d, "text"),
}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_rows_stay(messy, name):
    assert ONE_ROW_EACH[name](messy).count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_empty_table(nothing, name):
    assert ONE_ROW_EACH[name](nothing).count() == 0


@pytest.mark.parametrize("name", sorted(set(ONE_ROW_EACH) - {"simhash", "shard", "html"}))
def test_other_columns_stay(messy, name):
    found = ONE_ROW_EACH[name](messy)
    assert {"doc_id", "text", "lang", "source"} <= set(found.columns)
    assert len({c.lower() for c in found.columns}) == len(found.columns)


def test_mixing_takes_leaf_and_id_as_one(messy, nothing):
    assert mix(messy).count() == len({(r[0], r[2], r[3]) for r in ROWS})
    assert mix(nothing).count() == 0
    assert mixed_documents(messy).columns == messy.columns


def test_near_dedup_keeps_columns(messy, nothing):
    kept = near_dedup(messy)
    assert kept.columns == messy.columns
    assert near_dedup(nothing).count() == 0


def test_exact_dedup_of_nulls_and_repeats(messy):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(messy).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False)} <= found
    assert (None, None, 1, True) in found


def test_exact_dedup_with_colliding_hashes(messy):
    same = lambda text: (F.lit(1), F.lit(2))
    plain = sorted(map(str, exact_dedup(messy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    forced = exact_dedup(messy, digest=same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(str, forced.collect())) == plain
    digests = {r["text_sha256"] for r in forced.collect()}
    assert hashlib.sha256(b"").hexdigest() in digests


def test_drop_copies(messy, nothing):
    stay = drop_copies(messy)
    assert stay.columns == messy.columns and drop_copies(nothing).count() == 0
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    want = exact_dedup(messy.withColumnRenamed("kept", "old_kept")).where("kept")
    assert sorted(map(key, stay.collect())) == sorted(map(key, want.collect()))


def test_exact_dedup_smallest(messy):
    found = {(r["doc_id"], r["keep_id"]) for r in exact_dedup(messy, keep="smallest").collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3)} <= found


def test_line_dedup_counts_rows(spark):
    rows = [(i, "Common line \nown %d\n\ncommon LINE" % i) for i in range(10)] + [(99, None), (99, "common line"), (None, "own 1")]
    got = {
        (r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])
        for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert (3, 4, 2, "own 3\n") in got
    assert {(99, 1, 0, ""), (99, 1, 1, ""), (None, 1, 0, "own 1")} <= got


def test_quality_of_odd_texts(messy):
    got = {r["doc_id"]: r for r in quality(messy).collect()}
    assert (got[3]["n_words"], got[3]["base_failed"], got[3]["kept"]) == (0, True, False)
    assert (got[5]["n_words"], got[5]["n_dup_lines"]) == (0, 0)
    assert got[6]["n_repeat_words"] == 20_000
    assert got[1]["n_dup_lines"] == 0 and got[1]["kept"]


def test_stages_on_odd_rows(spark, messy, nothing, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for source in (messy, nothing):
        docs = source.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
