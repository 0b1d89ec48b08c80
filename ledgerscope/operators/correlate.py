"""Pearson correlation of predictors with the target, categories included.

The correlation of a 0/1 column with the target follows from counts alone, so categories are
grouped, never spread into columns. Only the few strongest variables become columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.sources.workspace import materialize

NULL_LEVEL = "nan"


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are known; null for a constant (``corr`` would fail)."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


_TABLE = "variable string, source string, level string, is_category boolean, correlation double"


def _category_correlations(df: DataFrame, columns: Sequence[str], target: str, rows: int, positives: int) -> DataFrame:
    # Rows are counted by all categories at once; only the short table of their combinations is spread out.
    combined = df.groupBy(*[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("y")
    )
    levels = combined.select(
        "n", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"_c{i}").alias("level")) for i, c in enumerate(columns)]))
    )
    counts = levels.groupBy("source", "level").agg(
        F.sum("n").cast("double").alias("n_level"), F.sum("y").cast("double").alias("y_level")
    )
    n, y, n_level = float(rows), float(positives), F.col("n_level")
    top = n * F.col("y_level") - n_level * y
    root = F.sqrt((n * n_level - n_level * n_level) * F.lit(n * y - y * y))
    return counts.select(
        F.concat_ws("_", "source", F.coalesce("level", F.lit(NULL_LEVEL))).alias("variable"),
        "source",
        "level",
        F.lit(True).alias("is_category"),
        F.try_divide(top, root).alias("correlation"),
    )


def target_correlations(
    df: DataFrame,
    numbers: Sequence[str],
    categories: Sequence[str] = S.CATEGORICAL_FEATURES,
    target: str = "incident",
) -> DataFrame:
    """Correlation of every variable with the 0/1 target; constants have none and are left out.

    A missing number is ignored for its own pair; a missing category is a level of its own. One
    aggregate gives all numbers and the totals that the categories need; it reaches the driver as a
    single row.
    """
    known = _known(df, numbers, categories, target)
    return _target_correlations(known, numbers, categories, target)


def _known(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str) -> DataFrame:
    """The columns that count, of rows with a target, written once: every aggregate reads them again."""
    columns = dict.fromkeys([target, *numbers, *categories])
    return materialize(df.where(F.col(target).isNotNull()).select(*columns), "correlate")


def _target_correlations(known: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str) -> DataFrame:
    y = F.col(target).cast("double")
    row = known.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum(F.col(target).cast("bigint")), F.lit(0)).alias("_positives"),
        *[_pearson(F.col(c).cast("double"), y).alias(c) for c in numbers],
    ).first()
    table = known.sparkSession.createDataFrame([(c, c, None, False, row[c]) for c in numbers], _TABLE)
    if categories:
        table = table.unionByName(_category_correlations(known, categories, target, row["_rows"], row["_positives"]))
    table = table.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return table.withColumn("strength", F.abs("correlation"))


def correlation_matrix(
    df: DataFrame,
    numbers: Sequence[str],
    categories: Sequence[str] = S.CATEGORICAL_FEATURES,
    target: str = "incident",
    top: int = 20,
) -> DataFrame:
    """Pairs (variable_a, variable_b, correlation) among the target and its strongest variables.

    The names of at most ``top`` variables reach the driver; all pairs come from one aggregate. Each
    pair is named in alphabetical order.
    """
    known = _known(df, numbers, categories, target)
    strongest = (
        _target_correlations(known, numbers, categories, target).orderBy(F.desc(F.round("strength", 12)), "variable").limit(top).collect()
    )

    def column(row) -> Column:
        if not row["is_category"]:
            return F.col(row["source"]).cast("double")
        return F.col(row["source"]).cast("string").eqNullSafe(F.lit(row["level"]).cast("string")).cast("double")

    values = {target: F.col(target).cast("double"), **{r["variable"]: column(r) for r in strongest}}
    names = list(values)
    # One row per left variable, so that the aggregate has one entry per variable and not per pair.
    rows = known.select(*[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    left = F.posexplode(F.array(*[F.col(f"_v{i}") for i in range(len(names))])).alias("a", "x")
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("b"), _pearson(F.col("x"), F.col(f"_v{i}")).alias("correlation"))
            for i in range(1, len(names))
        ]
    )
    table = rows.select("*", left).groupBy("a").agg(pairs.alias("pairs")).select("a", F.inline("pairs"))
    labels = F.array(*[F.lit(n) for n in names])
    one, other = F.get(labels, F.col("a")), F.get(labels, F.col("b"))
    return table.where(F.col("a") < F.col("b")).select(
        F.least(one, other).alias("variable_a"), F.greatest(one, other).alias("variable_b"), "correlation"
    )
