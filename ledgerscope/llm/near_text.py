"""Near copies of texts: Jaccard similarity of five-word shingles of 0.8 or more.

A text is the set of the hashes of its five-word shingles (letters A-Z in lower case). Candidates come from three passes, and the
whole sets decide on every one, so no pair below 0.8 is ever linked:

1. Multi-index hashing over the SimHash of the set finds the closest pairs, of equal fingerprints or up to 3 differing bits.
2. Band keys, each of ``ROWS`` minima of the set under fixed random orders: a pair at similarity s shares one with probability
   1 - (1 - s^ROWS)^BANDS, which is 0.9996 at 0.8 and more above. The members of a bucket meet its most central one, the one
   with the most neighbours in all its buckets, and the components of what is linked so far are named.
3. Only buckets that still hold several components go on, and only pairs across components matter there. In buckets of up to
   ``SMALL`` members all such pairs are compared. In the others the members are joined on single shingles, of which a set
   offers a prefix: sorted from rare to common, the shingles that can be the first common one with a set of the partner's
   size. Common shingles come last, so texts that merely share a passage or a template do not meet. Of the entries of a shingle
   the largest component is only ever looked up, so a crowd of linked copies does not meet itself.

Pairs within a component would change nothing. Sets hold 32 bits of each hash: in a text of n words two shingles meet by chance with
probability n^2 / 2^33, which changes the overlap by one.

Defined results: null text counts as empty; texts shorter than a shingle are one shingle, texts without a word are equal to each
other. Rows and ids may repeat: of a component all rows of the smallest id stay; null ids are smaller than none. An empty table
gives an empty table. Input columns keep their names and values, whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import drop_listed, stored, unfolded, whole_text
from ledgerscope.llm.components import components
from ledgerscope.llm.simhash import near_pairs

SHINGLE = 5
SEED = 42
#: The least similarity of copies, as a fraction of whole numbers.
SIMILAR, OF = 4, 5
BANDS, ROWS = 20, 5
#: Buckets of so many members compare all pairs across components.
SMALL = 16
#: Bits of the map of rows whose sets are asked for, and counters of shingles: a few MB, whatever the input.
MAP_BITS, COUNTERS = 1 << 24, 1 << 20
#: Classes of set sizes are steps of about 1 / STEPS.
STEPS = 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: So many hashes are put in order at once.
_CHUNK = 4096
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FLIPS, _FACTORS = _DRAWS[0], _DRAWS[1] | np.uint64(1)

_SKETCH = T.StructType().add("node", T.LongType()).add("n", T.IntegerType()).add("fp", T.LongType()).add("keys", T.ArrayType(T.LongType()))
_SET = T.StructType().add("node", T.LongType()).add("items", T.ArrayType(T.IntegerType()))
_OFFER = T.ArrayType(T.StructType().add("token", T.IntegerType()).add("pos", T.IntegerType()))


def _line(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only


def shingles(words: list[bytes]) -> np.ndarray:
    """The different hashes of the shingles, ascending."""
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its minima, hashed."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        order = (hashes[None, k : k + _CHUNK] ^ _FLIPS) * _FACTORS
        order ^= order >> np.uint64(32)
        order *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, order.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)), np.uint64, BANDS)


def _node(words: list[bytes]) -> int:
    """The words stand for the text; a signed number."""
    value = xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)
    return value - (1 << 64) if value >> 63 else value


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


@F.pandas_udf(_SKETCH)
def _sketches(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        hashes = shingles(words := _line(t))
        out.append((_node(words), len(hashes), set_fingerprint(hashes), band_keys(hashes).view(np.int64)))
    return pd.DataFrame(out, columns=["node", "n", "fp", "keys"])


def _sizes_fit(a: Column, b: Column) -> Column:
    """The smaller set is large enough for a pair to be similar."""
    return F.least(a, b) * OF >= F.greatest(a, b) * SIMILAR


def _row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col))


def _sets_of(docs: DataFrame, text_col: str, row: Column, wanted: DataFrame) -> DataFrame:
    """``node, items`` of the rows whose hash is in ``wanted``, and by chance of a few others; no text is shuffled.

    What is wanted reaches the workers as a map of ``MAP_BITS`` bits.
    """
    bits = wanted.select((F.pmod("row", F.lit(MAP_BITS)) + 1).alias("bit"))  # Spark's maps begin at 1
    bits = bits.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    maps = bits.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
    found = np.zeros(MAP_BITS // 8, np.uint8)
    for part in maps.toLocalIterator():  # 512 maps of 4 KB
        at = (part["bucket"] - 1) * 4096
        found[at : at + 4096] = np.frombuffer(part["map"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf(_SET)
    def sets(text: pd.Series, bit: pd.Series) -> pd.DataFrame:
        at = bit.to_numpy()
        asked = (shared.value[at // 8] >> (at % 8)) & 1 == 1
        out = []
        for t, yes in zip(text, asked, strict=True):
            words = _line(t) if yes else []
            items = np.unique((shingles(words) >> np.uint64(32)).astype(np.uint32)).view(np.int32) if yes else None
            out.append((_node(words) if yes else None, items))
        return pd.DataFrame(out, columns=["node", "items"]).astype({"node": "Int64"})

    rows = docs.select(whole_text(text_col).alias("text"), F.pmod(row, F.lit(MAP_BITS)).alias("bit"))
    found_sets = rows.select(sets("text", "bit").alias("s")).select("s.*").where(F.col("node").isNotNull())
    return stored(found_sets.dropDuplicates(["node"]), "near-sets")  # rows with equal nodes have equal sets


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("_u"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("_v"))
    both = F.size(F.array_intersect("_u", "_v"))
    close = both * OF >= (F.size("_u") + F.size("_v") - both) * SIMILAR
    return pairs.join(left, "u").join(right, "v").where(close).select("u", "v")


def _closest(rows: DataFrame) -> DataFrame:
    """Pairs of nodes with equal or close fingerprints; of equal ones each meets the smallest node."""
    prints = stored(rows.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "near-prints")
    close = near_pairs(prints.select("fp"))
    close = close.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u")
    close = close.join(prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    crowded = stored(prints.where("first < last").select("fp", "first"), "near-shared-prints")
    same = rows.join(crowded, "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return close.union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _central(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``key, pivot, pivot_n``: the member of each bucket that has the most neighbours, counted over all its buckets."""
    reach = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("reach"))
    scored = members.join(stored(reach, "near-reach"), "node")
    best = scored.groupBy("key").agg(F.max(F.struct("reach", -F.col("node"), "n")).alias("b"))
    return best.select("key", (-F.col("b.col2")).alias("pivot"), F.col("b.n").alias("pivot_n"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * STEPS + 1e-9)


def _across(named: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components in the buckets of ``named`` (``key, node, n, root``) that hold several."""
    spread = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    mixed = named.join(stored(spread.join(sizes, "key").select("key", "size"), "near-mixed"), "key")
    mixed = stored(mixed, "near-mixed-members")

    few = mixed.where(F.col("size") <= SMALL)
    other = few.select("key", F.col("node").alias("v"), F.col("n").alias("v_n"), F.col("root").alias("v_root"))
    apart = (F.col("node") < F.col("v")) & (F.col("root") != F.col("v_root")) & _sizes_fit(F.col("n"), F.col("v_n"))
    small = few.join(other, "key").where(apart).select(F.col("node").alias("u"), "v")

    crowd = mixed.where(F.col("size") > SMALL).select("node", "root").distinct()
    crowd = stored(crowd.join(sets, "node").select("node", "root", "items"), "near-crowd")
    return small.union(_by_prefix(crowd)).distinct()


def _by_prefix(crowd: DataFrame) -> DataFrame:
    """Pairs ``u, v`` across components that share a shingle of both prefixes; every similar pair is among them."""
    counted = crowd.select(F.explode("items").alias("token")).groupBy(F.pmod("token", F.lit(COUNTERS)).alias("at")).count()
    counts = np.zeros(COUNTERS, np.int64)
    found = counted.toArrow()
    counts[found["at"].to_numpy()] = found["count"].to_numpy()
    shared = crowd.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf(_OFFER)
    def offer(items: pd.Series) -> pd.Series:
        # The order may be any, as long as it is one for all sets; counts of several shingles together are good enough.
        out = []
        for x in items:
            x = np.asarray(x, np.int32)
            order = np.lexsort((x, shared.value[x % COUNTERS]))
            first = x[order[: len(x) - (len(x) * SIMILAR + OF - 1) // OF + 1]]
            out.append([{"token": int(t), "pos": i} for i, t in enumerate(first)])
        return pd.Series(out)

    entries = crowd.select("node", "root", F.size("items").alias("n"), F.explode(offer("items")).alias("o"))
    entries = stored(entries.select("node", "root", "n", "o.token", "o.pos"), "near-entries")
    parts = entries.groupBy("token", "root").count().groupBy("token").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("count", "root")).getField("root").alias("main")
    )
    several = stored(parts.where("parts > 1").select("token", "main"), "near-tokens")
    entries = stored(entries.join(several, "token"), "near-mixed-entries")

    # A common shingle at this place leaves n - pos: both sets must have as many as their similarity asks for.
    both = SIMILAR + OF
    largest = F.expr(f"({both} * (n - pos) - {SIMILAR} * n) div {SIMILAR}")
    classes = F.sequence(_size_class(F.ceil(F.col("n") * SIMILAR / OF)), _size_class(largest))
    asking = entries.where(F.col("root") != F.col("main")).where(largest * OF >= F.col("n") * SIMILAR)
    asking = asking.select(
        "token", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("root").alias("a_root"),
        F.explode(classes).alias("class"),
    )
    index = entries.withColumn("class", _size_class(F.col("n")))
    total = F.col("n") + F.col("a_n")
    fits = (F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos")) * both >= total * SIMILAR) & (
        (F.col("pos") + F.col("a_pos")) * both <= total
    )
    apart = (F.col("a_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("node")))
    pairs = unfolded(asking).join(index, ["token", "class"]).where(apart & fits)
    return pairs.select(F.least("a", "node").alias("u"), F.greatest("a", "node").alias("v"))


def near_text_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``component_id`` of every row."""
    row = _row_hash(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), _sketches(whole_text(text_col)).alias("s"))
    rows = stored(rows.select("id", "row", "s.*"), "near-sketches")

    members = rows.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    members = stored(unfolded(members).join(stored(shared, "near-keys"), "key").distinct(), "near-members")
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    star = members.join(stored(_central(members, sizes), "near-pivots"), "key")
    star = star.where((F.col("node") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pivot_n")))
    star = star.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    first = stored(_closest(rows).union(star).distinct(), "near-first-pairs")

    asked = members.select("node").union(first.select("u")).union(first.select("v")).distinct()
    chosen = rows.join(stored(asked, "near-asked"), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    sets = _sets_of(docs, text_col, row, chosen)
    linked = stored(_similar(first, sets), "near-first-links")

    roots = stored(components(linked), "near-first-components")
    named = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rest = stored(_across(stored(named, "near-named"), sizes, sets), "near-rest-pairs")
    linked = linked.union(_similar(rest, sets))

    smallest = rows.groupBy("node").agg(F.min("id").alias("least"))
    # A null id is smaller than none, so a component is named null only if all its ids are.
    roots = stored(components(linked), "near-components")
    named = smallest.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = stored(named, "near-texts")
    labels = named.join(stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "near-labels"), "root")
    labelled = rows.join(stored(labels.select("node", "component_id"), "near-nodes"), "node")
    return labelled.select(F.col("id").alias(id_col), "component_id")


def near_text_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, all columns."""
    labels = near_text_labels(docs, id_col, text_col).toDF("_nt_id", "_nt_component")
    gone = labels.where(~F.col("_nt_id").eqNullSafe(F.col("_nt_component"))).select(F.col("_nt_id").alias("_nt_gone"))
    gone = stored(gone.distinct(), "near-gone")
    return drop_listed(docs, gone, docs[id_col].eqNullSafe(gone["_nt_gone"]))
