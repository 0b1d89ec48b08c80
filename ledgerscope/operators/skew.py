"""Hot keys: find them with a bounded result, and join around them.

One supplier may own a third of all invoices. The helpers here keep such a key from landing in one
task. The driver only ever sees the list of hot keys, whose length is limited by ``MAX_HOT_KEYS``:
every key left out of that list owns at most ``rows / MAX_HOT_KEYS`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
HOT_KEY_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
MAP_BITS = 32_768  # of one bit map: what ``bitmap_construct_agg`` makes
MAP_BYTES = 64 << 20
BITS_PER_KEY, MIN_BITS_PER_KEY = 16, 2
HASHED_KINDS = ("string", "byte", "short", "integer", "long")


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``min_rows`` rows and how many rows each has. ``None`` is the null key."""

    rows: dict[object, int]

    def __bool__(self) -> bool:
        return bool(self.rows)

    def table(self, df: DataFrame, key: str) -> DataFrame:
        """The keys as a local table with the key type of ``df``."""
        field = df.schema[key]
        schema = f"`{key}` {field.dataType.simpleString()}, hot_rows bigint"
        return df.sparkSession.createDataFrame(list(self.rows.items()), schema)


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_KEY_ROWS, limit: int = MAX_HOT_KEYS) -> HotKeys:
    """The most frequent keys above ``min_rows``: one partially aggregated count and a top-k."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") > min_rows).orderBy(F.desc("n"), F.col(key)).limit(limit).collect()
    return HotKeys({row[key]: row["n"] for row in top})


def has_at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough, in rows and in bytes; ``rows`` of zero answers without a job.

    Bytes are the true lengths of texts, and 16 for any other value.
    """
    if rows <= 0:
        return False
    texts = [F.coalesce(F.sum(F.octet_length(f"`{c}`").cast("bigint")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    fixed = 16 * len(df.columns)
    total = F.count(F.lit(1)) * fixed
    for t in texts:
        total = total + t
    found = df.agg(F.count(F.lit(1)).alias("n"), total.alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def null_safe_key(key: Column) -> Column:
    """A non-null text that keeps null apart from every key, for grouping and joining."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def join_many_to_one(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    *,
    how: str = "left",
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join facts to a dimension with unique keys without gathering a hot key in one task.

    A dimension of checked size is broadcast. A larger one is shuffled, except for the hot fact
    keys: their few dimension rows are broadcast. Null keys match nothing and are not shuffled.
    ``small`` passes on a size check already made for ``dim`` or for a table it is part of.
    """
    if has_at_most(dim, broadcast_rows) if small is None else small:
        return facts.join(F.broadcast(dim), key, how)

    keyed = facts.where(F.col(key).isNotNull())
    hot = hot_keys(keyed, key, hot_rows)
    parts = []
    if hot:
        hot_list = F.broadcast(hot.table(facts, key).select(key))
        hot_dim = dim.join(hot_list, key, "left_semi")  # at most one row per hot key
        parts.append(keyed.join(hot_list, key, "left_semi").join(F.broadcast(hot_dim), key, how))
        keyed = keyed.join(hot_list, key, "left_anti")
    parts.insert(0, keyed.join(dim.hint("merge"), key, how))
    if how == "left":
        dim_only = [c for c in dim.columns if c != key]
        types = {f.name: f.dataType for f in dim.schema.fields}
        unkeyed = facts.where(F.col(key).isNull())
        parts.append(unkeyed.withColumns({c: F.lit(None).cast(types[c]) for c in dim_only}))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --------------------------------------------------------------------------- bit map of a key list
def _bit_of(key: Column, bits: int) -> tuple[Column, Column]:
    """The bit map of a key, and its bit there."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(at / MAP_BITS), at % MAP_BITS


def key_bit_maps(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bit per hashed key, as rows of 4,096 bytes: ``_km_map`` and ``_km_bits``. Null keys have no bit.

    Keys are shuffled to their bit map before it is built, so that no partial map crosses the network.
    """
    number, bit = _bit_of(F.col(key), bits)
    placed = keys.where(F.col(key).isNotNull()).select(number.alias("_km_map"), bit.alias("_km_bit"))
    return placed.repartition("_km_map").groupBy("_km_map").agg(F.bitmap_construct_agg("_km_bit").alias("_km_bits"))


def maybe_listed(rows: DataFrame, keys: DataFrame, key: str, *, max_bytes: int = MAP_BYTES) -> DataFrame:
    """The rows whose key may be listed: all that are, and of the others about one in ``BITS_PER_KEY``.

    The bit maps have ``BITS_PER_KEY`` bits per key and at most ``max_bytes``, and are broadcast, so rows are dropped in the stage that
    reads them. Where that leaves less than ``MIN_BITS_PER_KEY`` they would drop little, and all rows are returned. So they are
    for keys whose type is neither text nor a whole number, or differs between both sides: equal keys might hash differently.
    """
    kind = rows.schema[key].dataType
    if kind != keys.schema[key].dataType or kind.typeName() not in HASHED_KINDS:
        return rows
    n = keys.count()
    bits = min(max_bytes * 8, n * BITS_PER_KEY) // MAP_BITS * MAP_BITS
    bits = max(bits, MAP_BITS)
    if n * MIN_BITS_PER_KEY > bits:
        return rows
    number, bit = _bit_of(F.col(key), bits)
    maps = F.broadcast(key_bit_maps(keys, key, bits))  # at most max_bytes, and 32 kilobit for a short list
    byte = F.conv(F.hex(F.substring("_km_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_km_byte, _km_bit % 8) & 1") == 1
    found = rows.withColumn("_km_map", number).join(maps, "_km_map")
    found = found.withColumns({"_km_byte": byte, "_km_bit": bit.cast("int")}).where(is_set)
    return found.drop("_km_map", "_km_bits", "_km_byte", "_km_bit")


def semi_join_keys(
    rows: DataFrame,
    keys: DataFrame,
    key: str,
    *,
    how: str = "left_semi",
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Keep (or with ``left_anti`` drop) the rows whose key is listed; broadcast a small list only.

    Beside a long list, rows that a bit map of the keys rules out are not shuffled, the rows of hot keys meet only the listed ones among
    those keys, which are few and broadcast, and null keys are listed nowhere and are not shuffled.
    """
    keys = keys.select(key)
    if has_at_most(keys, broadcast_rows) if small is None else small:
        return rows.join(F.broadcast(keys), key, how)
    keyed = rows.where(F.col(key).isNotNull())
    if how == "left_semi":
        keyed = maybe_listed(keyed, keys, key)
    hot = hot_keys(keyed, key, hot_rows)
    parts = []
    if hot:
        hot_list = F.broadcast(hot.table(rows, key).select(key))
        hot_listed = F.broadcast(keys.join(hot_list, key, "left_semi").distinct())  # at most the hot keys
        parts.append(keyed.join(hot_list, key, "left_semi").join(hot_listed, key, how))
        keyed = keyed.join(hot_list, key, "left_anti")
    parts.insert(0, keyed.join(keys.hint("merge"), key, how))
    if how == "left_anti":
        parts.append(rows.where(F.col(key).isNull()))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
