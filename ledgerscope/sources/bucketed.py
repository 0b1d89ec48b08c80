"""Tables in buckets by key, so that large joins by that key need no shuffle.

Facts and dimensions are written in the same buckets and sorted by key; each task of the join reads one bucket of either. A key that
owns a third of the facts would make one bucket a third of the table, so buckets are cut by (key, part): a fact row has a part drawn
from a hash of its number, and a dimension row is there once for each part. That multiplies the dimension by ``PARTS``, which is the price of
never moving the facts again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.sources.workspace import workspace

BUCKETS, PARTS = 64, 8
PART = "_part"


def _write(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Written to the shared folder; the catalog of the session only knows where, and in which buckets."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    arranged = df.repartition(buckets, key, PART)
    arranged.write.bucketBy(buckets, key, PART).sortBy(key, PART).option("path", workspace(spark, name)).saveAsTable(table)
    return spark.table(table)


def bucketed_facts(df: DataFrame, name: str, key: str, order: str, buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """Facts in buckets; ``order`` is a column that differs from row to row. Null keys are spread over the parts like any key."""
    return _write(df.withColumn(PART, F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")), name, key, buckets)


def bucketed_dimension(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """A dimension in the buckets of its facts."""
    copies = df.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _write(copies, name, key, buckets)


def bucketed_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join two tables of the same buckets and parts; neither is shuffled."""
    return facts.join(dim.hint("merge"), [key, PART], how).drop(PART)
