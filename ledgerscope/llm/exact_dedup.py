"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

First the hashes alone are counted. Texts are compared only where a hash occurs twice or more: there the text itself is one of
the grouping keys, so only equal bytes meet and a collision of the hash forms two groups. Map tasks combine their copies
before both shuffles: of a text that a third of all rows repeat, each task sends one row. The rows then look up the
groups of two or more by hash, in a join without texts, whose hot keys adaptive execution splits.

Defined results: null text equals empty text. Of equal texts the row with the largest (or smallest)
id stays. Rows that share text and id are one document to this operator and are kept or dropped
together; null ids are never preferred, and in a group with null ids only all its rows are kept. An empty
table gives an empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import drop_listed, hash128, stored, table, whole_text, without

KEYS = ["_xd_h1", "_xd_h2", "_xd_sha"]
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest: Callable[[Column], tuple[Column, Column]] = hash128,
) -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    choose = {"largest": F.max, "smallest": F.min}[keep]
    h1, h2 = digest(whole_text(text_col))
    rows = without(docs, *RESULTS).withColumns(
        {"_xd_h1": h1, "_xd_h2": h2, "_xd_sha": F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256))}
    )
    repeated = rows.groupBy(*KEYS[:2]).agg(F.count(F.lit(1)).alias("_xd_n")).where(F.col("_xd_n") > 1).select(*KEYS[:2])
    copies = rows.join(stored(repeated, "repeated-hashes"), KEYS[:2], "left_semi")
    texts = copies.groupBy(*KEYS, whole_text(text_col).alias("_xd_text")).agg(
        choose(id_col).alias("_xd_keep"), F.count(F.lit(1)).alias("_xd_size")
    )
    groups = (
        texts.groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("_xd_texts"), F.max("_xd_keep").alias("_xd_keep"), F.max("_xd_size").alias("_xd_size"))
        .where((F.col("_xd_size") > 1) | (F.col("_xd_texts") > 1))
        .withColumn(
            "_xd_size",
            F.when(F.col("_xd_texts") == 1, F.col("_xd_size")).otherwise(
                F.raise_error(F.lit("different texts agree in the content hash and in SHA-256")).cast("long")
            ),
        )
        .select(*KEYS, "_xd_keep", "_xd_size")
    )
    found = rows.join(stored(groups, "copies"), KEYS, "left")
    keep_id = F.when(F.col("_xd_size").isNull(), F.col(id_col)).otherwise(F.col("_xd_keep"))
    return found.withColumns(
        {
            "keep_id": keep_id,
            "group_size": F.coalesce("_xd_size", F.lit(1).cast("long")),
            "kept": keep_id.eqNullSafe(F.col(id_col)),
            "text_sha256": F.lower(F.hex("_xd_sha")),
        }
    ).drop(*KEYS, "_xd_keep", "_xd_size")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows that stay, all columns. What goes is listed by id and hash, so the texts are not shuffled for it."""
    a, b = hash128(whole_text(text_col))
    narrow = docs.select(F.col(id_col).alias("_xd_id"), F.col(text_col).alias("_xd_text"), a.alias("_xd_a"), b.alias("_xd_b"))
    gone = exact_dedup(narrow, "_xd_id", "_xd_text", keep).where(~F.col("kept")).select("_xd_id", "_xd_a", "_xd_b").distinct()
    gone = stored(gone, "copies-gone")
    same = docs[id_col].eqNullSafe(gone["_xd_id"]) & (a == gone["_xd_a"]) & (b == gone["_xd_b"])
    return drop_listed(docs, gone, same)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *RESULTS)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""
