"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import unfolded

#: A node with very many edges is joined in so many parts.
SALTS = 8
MOST_ROUNDS = 60


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """For each ``u``: the smallest of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _with_smallest(edges: DataFrame) -> DataFrame:
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    small = _smallest_neighbour(edges).withColumn("salt", salts)
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(unfolded(small), ["u", "salt"]).drop("salt")


def _star(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours, then smaller ones, are moved to the smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_smallest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.where(F.col("u") != F.col("v")).distinct()  # every edge from the larger to the smaller node
    small = _with_smallest(down).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return small.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``; the root is the smallest node of the component.

    Alternating star rounds: each keeps the components, shortens the paths and ends when every node
    points at its root. The edges are checkpointed each round; only two sums per round reach the driver.
    An empty table gives an empty table; loops and repeated edges do no harm, edges with nulls are left out.
    """
    pairs = (
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()  # read twice
    )
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = pairs.where(F.col("u") != F.col("v"))
    mark = None
    for _ in range(MOST_ROUNDS):
        # A round that changes nothing leaves stars: every node has one edge, to its root.
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("u", "v"))
        ).first()
        if seen == mark or seen[0] == 0:
            break
        mark, now = seen, _star(now).checkpoint()
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
