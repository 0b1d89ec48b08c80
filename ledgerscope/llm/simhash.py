"""SimHash near-duplicates, linked by multi-index hashing.

A fingerprint sums the bits of the XXH64 hashes of all word shingles. Equal fingerprints are put
together first, so copies never meet in pairs. Fingerprints at 3 or fewer differing bits differ in at most
one bit in one of their two 32-bit halves. Each half is a table; a fingerprint looks up its own half and the
halves that differ from it in one bit, and whole distances decide. Of two halves that differ in one bit one
has it clear, so it is enough that every fingerprint sets its clear bits: about 17 keys per half, and each pair is
still found.

A half that very many different fingerprints share (near copies of one text do) would compare all with all.
Halves with more than ``BUCKET`` entries are searched again one level down, with the other half cut into two
16-bit quarters of which one differs in at most one bit, so candidates agree in about 48 bits.

Defined results: null text counts as empty; texts without a word get fingerprint zero and are linked
like any others; texts shorter than a shingle are one shingle. Rows may repeat: a component is named by its
smallest id; null ids are smaller than none, so a component of null ids only is named null. An empty
table gives an empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import stored, table, unfolded, whole_text, without
from ledgerscope.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKET = 256
RESULTS = ("fingerprint", "component_id")

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: So many hashes are unpacked to bits at once.
_CHUNK = 65_536


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(first, last, strict=True)), ">u8", len(first))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in text), np.uint64, len(text))
    return pd.Series(values.view(np.int64))


def _keys(fp: Column, half: int, flips: bool) -> Column:
    """Keys of one half: itself, and with ``flips`` also with one of its clear bits set."""
    value = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    tag = F.lit(half << 32)
    if not flips:
        return (tag + value).alias("key")
    balls = [F.when(value.bitwiseAND(F.lit(1 << b)) == 0, tag + value + F.lit(1 << b)) for b in range(32)]
    return F.explode(F.filter(F.array(tag + value, *balls), lambda k: k.isNotNull())).alias("key")


def _other_quarters(fp: Column, half: Column, ball: bool) -> Column:
    """The quarters of the half that was not looked up, with ``ball`` also all that differ in one bit."""
    other = F.when(half == 1, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    out = []
    for q in (0, 1):
        value = F.shiftrightunsigned(other, 16 * q).bitwiseAND(F.lit(0xFFFF))
        changed = [value] + [value.bitwiseXOR(F.lit(1 << b)) for b in range(16) if ball]
        out += [F.lit(q << 16) + v for v in changed]
    return F.explode(F.array(*out)).alias("quarter")


def near_pairs(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """All pairs ``u, v`` of different fingerprints ``fp`` at ``distance`` or fewer differing bits; pairs may repeat."""
    if distance > 3:
        raise ValueError("two halves with balls of one bit find distances up to 3")
    fp = F.col("fp")
    index = prints.select("fp", _keys(fp, 0, False)).union(prints.select("fp", _keys(fp, 1, False)))
    probes = prints.select("fp", _keys(fp, 0, True)).union(prints.select("fp", _keys(fp, 1, True)))
    hot = stored(index.groupBy("key").count().where(F.col("count") > bucket).select("key"), "hot-halves")
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance) & (F.col("fp") != F.col("other"))

    entries = index.withColumnRenamed("fp", "other")
    if hot.isEmpty():  # as a rule; spares the second search
        plain = unfolded(probes).join(entries, "key").where(close)
        return plain.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))
    plain = unfolded(probes).join(entries.join(hot, "key", "left_anti"), "key").where(close)

    half = F.shiftrightunsigned(F.col("key"), 32)
    crowd = entries.join(hot, "key", "left_semi").select("key", "other", _other_quarters(F.col("other"), half, False))
    asking = probes.join(hot, "key", "left_semi").select("key", "fp", _other_quarters(fp, half, True))
    crowded = unfolded(asking).join(unfolded(crowd), ["key", "quarter"]).where(close)

    pairs = plain.select("fp", "other").union(crowded.select("fp", "other"))
    return pairs.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row."""
    rows = stored(docs.select(F.col(id_col), _fingerprints(whole_text(text_col)).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = components(near_pairs(prints.select("fp")))
    named = prints.join(roots, prints["fp"] == roots["node"]).select("fp", "least", "root")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "root").select("fp", F.col("component_id").alias("_linked"))
    labels = prints.join(linked, "fp", "left").select("fp", F.coalesce("_linked", "least").alias("component_id"))
    return (
        rows.join(stored(labels, "components"), "fp")
        .withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
        .select(id_col, *RESULTS)
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, all columns."""
    labels = simhash(docs, id_col, text_col)
    gone = labels.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_sh_gone"))
    gone = stored(gone.distinct(), "near-copies")  # narrow, and of known size: broadcast only if small
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_sh_gone"]), "left_anti")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(without(table(spark, sf_dir, "documents"), *RESULTS).select("doc_id", "text"))
