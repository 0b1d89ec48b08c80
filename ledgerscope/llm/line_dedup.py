"""Line deduplication: explode normalised lines, hash, count documents, drop, reassemble by position.

Only 128-bit hashes and positions of lines are shuffled, counted on the map side first. The text
meets the positions to drop in one join on the document id.

Defined results: null or empty text is one empty line. A line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys shorter than ``min_chars`` are never dropped. Every row is
a document of its own when counting; rows that share an id are told apart by the hash of their text.
When all lines go, the text is empty. An empty table gives an empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import ascii_lower, hash128, stored, strip_space, table, whole_text, without

RESULTS = ("n_lines", "n_dropped", "kept_text")


def _lines(text_col: str) -> Column:
    return F.split(whole_text(text_col), "\n", -1)


def _key(line: Column, min_chars: int) -> Column:
    """The hash of a line's key; null where the key is too short to count."""
    h1, h2 = hash128(line)
    return F.when(F.length(line) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All rows with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    docs = without(docs, *RESULTS)
    # Lower-casing and stripping leave line breaks alone, so the text is lower-cased at once.
    lines = F.split(ascii_lower(whole_text(text_col)), "\n", -1)
    keys = F.transform(lines, lambda line: _key(strip_space(line), min_chars))
    docs = docs.withColumn("_ld_text", F.xxhash64(whole_text(text_col)))
    hashed = docs.select(F.col(id_col).alias("_ld_id"), "_ld_text", keys.alias("_ld_keys"))
    frequent = (
        hashed.select(F.explode(F.array_distinct("_ld_keys")).alias("k"))
        .where(F.col("k").isNotNull())
        .groupBy("k.h1", "k.h2")
        .agg(F.count(F.lit(1)).alias("_ld_docs"))
        .where(F.col("_ld_docs") >= min_docs)
        .select("h1", "h2")
    )
    places = hashed.select("_ld_id", "_ld_text", F.posexplode("_ld_keys").alias("pos", "k")).where(F.col("k").isNotNull())
    drops = (
        places.select("_ld_id", "_ld_text", "pos", "k.h1", "k.h2")
        .join(stored(frequent, "frequent-lines"), ["h1", "h2"], "left_semi")
        .groupBy(F.col("_ld_id").alias("_ld_for"), "_ld_text")
        .agg(F.collect_set("pos").alias("_ld_drops"))  # positions of one document
    )
    same = F.col(id_col).eqNullSafe(F.col("_ld_for")) & (docs["_ld_text"] == drops["_ld_text"])
    found = docs.join(drops, same, "left").drop("_ld_for", "_ld_text")
    n = F.size(_lines(text_col))
    kept = F.when(
        F.col("_ld_drops").isNotNull(), F.array_except(F.sequence(F.lit(0), n - 1), F.col("_ld_drops"))
    )
    return (
        found.withColumn("_ld_kept", kept)
        .withColumns(
            {
                "n_lines": n.cast("long"),
                "n_dropped": F.coalesce(n - F.size("_ld_kept"), F.lit(0)).cast("long"),
                "kept_text": F.when(F.col("_ld_kept").isNull(), whole_text(text_col)).otherwise(
                    F.transform(
                        F.array(_lines(text_col)),
                        lambda all_lines: F.array_join(F.transform("_ld_kept", lambda i: F.get(all_lines, i)), "\n"),
                    )[0]
                ),
            }
        )
        .drop("_ld_drops", "_ld_kept")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


_STRIPPED = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, l,
  translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
