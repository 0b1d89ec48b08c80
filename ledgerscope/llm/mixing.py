"""Mixing sources to target weights: budgets down a tree of domain, language and source.

The token budget goes from the root to the leaves in proportion to integer weights. A node can supply its
tokens ``max_epochs`` times. Where a child can't fill its share, the rest goes to its siblings by weight,
and only what all of them can't take is missing in their parent, whose siblings take it: each level is filled
up to its supply, and a level's budget never exceeds what lies below it. Filling sorts the children of a node
by supply per weight; all divisions are of integers, which may leave a few tokens per node unused.

A leaf takes all its documents as often as its budget holds all its tokens, and of one more epoch a prefix: the
documents in the order of a hash of seed and id, up to the last one whose running sum of tokens still
fits. The sum is taken over slices of that order first, so a leaf with a third of all rows is sorted in parts.

Defined results: null text has no tokens, null levels are a name of their own (``null``). Rows that share leaf and id are one
document with the sum of their tokens and taken or left together. A document without tokens is taken when
its turn comes in the prefix. Weights default to 1. An empty table gives an empty table. Input columns named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.llm.common import WORD, stored, table, uniform52, whole_text, without

ROWS_PER_SLICE = 200_000
LEVELS = ("domain", "language", "origin")
RESULTS = ("domain", "n_tokens", "leaf_budget", "copies")


@dataclass(frozen=True)
class Plan:
    """Weights of names by level, the share of all tokens that the mix is to have, and how often a document may be used."""

    domain: Mapping[str, int] = field(default_factory=dict)
    language: Mapping[str, int] = field(default_factory=dict)
    origin: Mapping[str, int] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 4
    seed: str = "mix"


#: Production weights. Sources are grouped into four domains by the number in their name.
PLAN = Plan(
    domain={"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    language={"en": 6, "de": 2, "fr": 2, "es": 2},
    origin={"src0": 1},
    budget_percent=90,
    max_epochs=3,
)


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo four; ``other`` without a number."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def _weight(level: Column, weights: Mapping[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain(*weights.items())]) if weights else None
    return F.coalesce(known[level], F.lit(1)).cast("long") if known is not None else F.lit(1).cast("long")


def fill(nodes: DataFrame, parent: Sequence[str], order: str) -> DataFrame:
    """Divide ``parent_budget`` among the children of each parent: ``budget`` for each row.

    A row has ``supply`` and ``weight``. In the order of supply per weight a child is filled to its supply
    as long as an equal share per weight of what is left would be more than that; the others divide the rest.
    """
    by = Window.partitionBy(*parent)
    ranked = by.orderBy(F.col("supply") / F.col("weight"), order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("parent_budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))
    weight_left = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = F.col("supply") * F.col("_weight_left") <= F.col("_left") * F.col("weight")
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(by), F.lit(0))
    weight_open = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by)
    return (
        nodes.withColumns({"_left": left, "_weight_left": weight_left})
        .withColumn("_full", full)
        .withColumns({"_rest": F.greatest(F.col("parent_budget") - taken, F.lit(0)), "_open": weight_open})
        .withColumn(
            "budget",
            F.when(F.col("_full"), F.col("supply")).otherwise(F.expr("(_rest * weight) div greatest(_open, 1)")),
        )
        .drop("_left", "_weight_left", "_full", "_rest", "_open")
    )


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``budget`` of each leaf of a table of the levels and ``tokens``."""
    supply = F.col("tokens") * plan.max_epochs
    d, l, o = LEVELS  # noqa: E741
    sources = leaves.select(*LEVELS, "tokens", supply.alias("supply"), _weight(F.col(o), plan.origin).alias("weight"))
    languages = sources.groupBy(d, l).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    domains = languages.groupBy(d).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    top = domains.withColumns({"weight": _weight(F.col(d), plan.domain), "_all": F.sum("tokens").over(Window.partitionBy(F.lit(0)))})
    top = top.withColumn("parent_budget", F.expr(f"cast(_all AS decimal(38,0)) * {int(plan.budget_percent)} div 100")).drop("_all")
    top = fill(top.withColumn("root", F.lit(0)), ["root"], d).select(d, F.col("budget").alias("parent_budget"))
    middle = languages.withColumn("weight", _weight(F.col(l), plan.language)).join(top, d)
    middle = fill(middle, [d], l).select(d, l, F.col("budget").alias("parent_budget"))
    return fill(sources.join(middle, [d, l]), [d, l], o).select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    plan: Plan = PLAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The id, levels, ``n_tokens``, ``leaf_budget`` and ``copies`` (how often it is in the mix) of every document.

    Tokens are words here; any other count can be had by handing in another text column.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    units = stored(
        docs.select(
            F.col(id_col),
            domain_of(name(source_col)).alias("domain"),
            name(lang_col).alias("language"),
            name(source_col).alias("origin"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("n_tokens"),
        )
        .groupBy(id_col, *LEVELS)
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("_at", uniform52(F.lit(plan.seed), F.col(id_col))),
        "mix-units",
    )
    rows = F.col("count")
    largest, total = units.groupBy(*LEVELS).count().agg(F.coalesce(F.max(rows), F.lit(0)), F.coalesce(F.sum(rows), F.lit(0))).first()
    # The largest leaf is cut so that no slice is more than a task's fair share, nor than a task should sort.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-largest // max(1, min(rows_per_slice, -(-total // tasks)))))
    cut = units.withColumn("_slice", F.floor(F.col("_at") / F.lit(float(1 << 52)) * slices))
    parts = cut.groupBy(*LEVELS, "_slice").agg(F.sum("n_tokens").alias("_sum"))
    budgets = leaf_budgets(units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan)
    before = Window.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        parts.join(budgets, list(LEVELS)).select(
            *LEVELS,
            "_slice",
            F.col("budget").alias("leaf_budget"),
            F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END").alias("_epochs"),
            F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END").alias("_part"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
        ),
        "mix-slices",
    )
    within = Window.partitionBy(*LEVELS, "_slice").orderBy("_at", id_col).rowsBetween(Window.unboundedPreceding, 0)
    in_prefix = F.col("_start") + F.col("_run") <= F.col("_part")
    return (
        cut.withColumn("_run", F.sum("n_tokens").over(within))
        .join(starts, [*LEVELS, "_slice"])
        .withColumn("copies", F.col("_epochs") + F.when(in_prefix, 1).otherwise(0))
        .select(id_col, *LEVELS, "n_tokens", "leaf_budget", "copies")
    )


def mixed_documents(docs: DataFrame, plan: Plan = PLAN, id_col: str = "doc_id") -> DataFrame:
    """The rows of the mix with all their columns; a document with several copies is several rows."""
    d, l, o = LEVELS  # noqa: E741
    chosen = mix(docs, plan, id_col).where(F.col("copies") > 0).select(
        F.col(id_col).alias("_mx_id"), F.col(l).alias("_mx_l"), F.col(o).alias("_mx_o"), F.col("copies").alias("_mx_copies")
    )
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    same = docs[id_col].eqNullSafe(chosen["_mx_id"]) & (name("lang") == chosen["_mx_l"]) & (name("source") == chosen["_mx_o"])
    copies = F.explode(F.sequence(F.lit(1), F.col("_mx_copies").cast("int"))).alias("_mx_copy")
    return docs.join(chosen, same).select(*docs.columns, copies).drop("_mx_copy")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without(table(spark, sf_dir, "documents"), *RESULTS)
    return mix(docs)


def _filled(source: str, parent: str, order: str) -> str:
    """Budgets of one level in SQL; the same rule as ``fill``, as a scan over the ordered children."""
    return f"""(SELECT *, CASE WHEN fulls THEN supply ELSE (greatest(parent_budget - coalesce(sum(CASE WHEN fulls THEN supply END) OVER p, 0), 0) * weight)
      // greatest(sum(CASE WHEN NOT fulls THEN weight END) OVER p, 1) END AS budget FROM
    (SELECT *, supply * (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER o, 0))
      <= (parent_budget - coalesce(sum(supply) OVER o, 0)) * weight AS fulls FROM {source}
     WINDOW o AS (PARTITION BY {parent} ORDER BY supply / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WINDOW p AS (PARTITION BY {parent}))"""


def _case(column: str, weights: Mapping[str, int]) -> str:
    return "CASE " + column + " ".join(["", *[f"WHEN '{k}' THEN {v}" for k, v in weights.items()]]) + " ELSE 1 END"


ORACLE = rf"""
WITH u AS (SELECT doc_id, coalesce('d' || (CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4), 'other') AS domain,
  coalesce(lang, 'null') AS language, coalesce(source, 'null') AS origin,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
  CAST('0x' || substr(md5('{PLAN.seed}:' || doc_id), 1, 13) AS BIGINT) AS drawn FROM documents),
s AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {PLAN.max_epochs} AS supply,
  {_case("origin", PLAN.origin)} AS weight FROM u GROUP BY ALL),
l AS (SELECT domain, language, CAST(sum(supply) AS BIGINT) AS supply, CAST(sum(tokens) AS BIGINT) AS tokens, {_case("language", PLAN.language)} AS weight
  FROM s GROUP BY ALL),
d AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply, {_case("domain", PLAN.domain)} AS weight, 0 AS root,
  (SELECT CAST(sum(tokens) * {PLAN.budget_percent} // 100 AS BIGINT) FROM s) AS parent_budget FROM l GROUP BY domain),
db AS {_filled("d", "root", "domain")},
lp AS (SELECT l.*, db.budget AS parent_budget FROM l JOIN db USING (domain)),
lb AS {_filled("lp", "domain", "language")},
sp AS (SELECT s.*, lb.budget AS parent_budget FROM s JOIN lb USING (domain, language)),
sb AS {_filled("sp", "domain, language", "origin")}
SELECT doc_id, domain, language, origin, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(budget AS BIGINT) AS leaf_budget,
  CAST(CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END + CASE WHEN sum(n_tokens) OVER
    (PARTITION BY domain, language, origin ORDER BY drawn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    <= CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM u JOIN sb USING (domain, language, origin)
"""
