"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the node draws a number from the hash of the id and the child's name, and the
smallest ``-ln(u) / weight`` wins, so a child gets its share of the weight. A child's draw depends on nothing
but the id and its own name: when weights change, rows move only below the nodes whose weights changed.
A new shard in a region of its own changes no other weight, hence takes rows only into itself
(``grow``); one put into an existing rack attracts rows from outside that region and its rack, and only that
region, that rack and the new shard gain rows.

Slots number the rows of a shard without gaps, in the order of a hash of the id. Rows are counted per shard
and slice of that order first; a slice is sorted on its own and starts at the count before it, so no task
holds a shard.

Defined results: null text has no bytes; a null id draws like the text ``null``. Rows that repeat an id go to the same
shard and get different slots, in the order of checksum and size. An empty table gives an empty table.
Input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.llm.common import stored, table, uniform52, whole_text, without

ROWS_PER_SLICE = 200_000
OVERHEAD = 16
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Node:
    """An inner node has children; a leaf has the number of its shard. ``weight`` is that of all leaves below."""

    name: str
    children: tuple[Node, ...] = ()
    leaf_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def uniform_tree(regions: int, racks: int, shards: int) -> Node:
    """Equal shards, numbered in the order of the tree."""
    number = iter(range(regions * racks * shards))
    tops = []
    for r in range(regions):
        inner = []
        for k in range(racks):
            leaves = tuple(Node(f"{r}/{k}/{s}", shard=next(number)) for s in range(shards))
            inner.append(Node(f"{r}/{k}", tuple(leaves)))
        tops.append(Node(f"{r}", tuple(inner)))
    return Node("", tuple(tops))


def count_shards(tree: Node) -> int:
    return sum(map(count_shards, tree.children)) if tree.children else 1


def grow(tree: Node) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    r, n = len(tree.children), count_shards(tree)
    leaf = Node(f"{r}/0/0", shard=n)
    return Node(tree.name, (*tree.children, Node(f"{r}", (Node(f"{r}/0", (leaf,)),))))


def place(key: Column, tree: Node, seed: str = "shard") -> Column:
    """The shard of a key: descend the tree by weighted draws."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(key, tree.children[0], seed)
    draws = []
    for i, child in enumerate(tree.children):
        u = (uniform52(F.lit(seed), F.lit(child.name), key) + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(float(child.weight))).alias("score"), F.lit(i).alias("i")))
    winner = F.array_min(F.array(*draws))["i"]
    if all(not c.children for c in tree.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in tree.children]), winner + 1)
    return F.transform(
        F.array(winner),
        lambda w: F.coalesce(*[F.when(w == i, place(key, c, seed)) for i, c in enumerate(tree.children)]),
    )[0]


def shard(
    docs: DataFrame,
    tree: Node,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    key, text = F.col(id_col), whole_text(text_col)
    placed = stored(
        docs.select(
            key,
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            place(key, tree).cast("int").alias("shard"),
            place(key, grow(tree)).cast("int").alias("grown_shard"),
            uniform52(F.lit("slot"), key).alias("_at"),
        ),
        "placed",
    )
    slices = max(1, -(-placed.count() // rows_per_slice))
    cut = placed.withColumn("_slice", F.floor(F.col("_at") / F.lit(float(1 << 52)) * slices))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("shard", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    order = Window.partitionBy("shard", "_slice").orderBy("_at", id_col, "text_crc32", "size")
    return (
        cut.withColumn("_row", F.row_number().over(order) - 1)
        .join(starts, ["shard", "_slice"])
        .withColumns({"slot": F.col("_start") + F.col("_row"), "law": F.lit("key")})
        .select(id_col, *RESULTS)
    )


TREE = uniform_tree(regions=2, racks=4, shards=5)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(without(docs, *RESULTS), TREE)


def _unit_sql(key: str, name: str) -> str:
    return f"((CAST('0x' || substr(md5('shard:{name}:' || {key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _place_sql(key: str, tree: Node) -> str:
    """The same descent in SQL: the child with the smallest draw, the first one on ties."""
    if not tree.children:
        return str(tree.shard)
    if len(tree.children) == 1:
        return _place_sql(key, tree.children[0])
    draws = ", ".join(f"-ln({_unit_sql(key, c.name)}) / {c.weight!r}" for c in tree.children)
    steps = " ".join(f"WHEN {i} THEN {_place_sql(key, c)}" for i, c in enumerate(tree.children, 1))
    return f"CASE list_position([{draws}], least({draws})) {steps} END"


ORACLE = f"""
WITH RECURSIVE bits(n, v, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(v ORDER BY n) AS of_byte FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h,
  CAST('0x' || substr(md5('slot:' || doc_id), 1, 13) AS BIGINT) AS drawn FROM documents),
c AS (SELECT doc_id, drawn, CAST(length(h) // 2 + {OVERHEAD} AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'),
    lambda x: instr('0123456789ABCDEF', x[1]) * 16 + instr('0123456789ABCDEF', x[2]) - 17)),
    lambda a, x: xor(a >> 8, of_byte[xor(a & 255, x) + 1])), 4294967295) AS text_crc32 FROM d, remainders),
p AS (SELECT *, CAST({_place_sql("doc_id", TREE)} AS INTEGER) AS shard, CAST({_place_sql("doc_id", grow(TREE))} AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY drawn, doc_id) - 1 AS slot FROM p
"""
