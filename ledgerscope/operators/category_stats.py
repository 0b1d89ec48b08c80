"""Ordered target statistics: categories as numbers that see only rows that come before.

Within a category the rows are put in an order drawn from a hash of their number. A row gets the share of incidents of the rows before it
in that order, drawn towards the share of all rows by ``PRIOR`` rows, so no row sees its own label. Rows that are not part of the
training take the share of all training rows of their category.

All columns are done in one shuffle of narrow rows. A category that holds a third of the rows is cut along the drawn order into slices
of about ``SLICE_ROWS`` rows; a slice starts from the totals of those before it, so the result is that of one long order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.sources.workspace import materialize

PRIOR = 1.0
SLICE_ROWS = 200_000
PLACES = 1 << 52


def drawn_place(order: Column, seed: int) -> Column:
    """A number in [0, 2**52) from the row's number."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(order.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def _tall(df: DataFrame, columns: Sequence[str], *others: Column) -> DataFrame:
    """A row for each column, as ``feature, level``; a missing level is one of its own."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(S.MISSING_CATEGORY)).alias("level"))
        for c in columns
    ])
    return df.select(*others, F.explode(entries).alias("e")).select("*", "e.feature", "e.level").drop("e")


def label_share(df: DataFrame, label: str = "label") -> float:
    return df.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0))).first()[0]


def _smoothed(positives: Column, rows: Column, share: float, prior: float) -> Column:
    return (positives + F.lit(share * prior)) / (rows + F.lit(prior))


def ordered_category_stats(
    df: DataFrame,
    columns: Sequence[str],
    *,
    label: str = "label",
    order: str = "row_no",
    prior: float = PRIOR,
    seed: int = S.SEED,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``order, feature, level, rows_before, value`` for every row and column; ``order`` must be unique."""
    share = label_share(df, label)
    tall = _tall(df, columns, F.col(order).alias("_order"), drawn_place(F.col(order), seed).alias("_place"), F.col(label).cast("long").alias("_label"))
    tall = materialize(tall, "category-rows")
    sizes = tall.groupBy("feature", "level").agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).alias("_slices"))
    sizes = materialize(sizes.where("_slices > 1"), "category-slices")  # few: each has more than slice_rows rows
    sliced = tall.join(sizes, ["feature", "level"], "left")
    part = F.floor(F.col("_place") / float(PLACES) * F.coalesce("_slices", F.lit(1)))
    sliced = sliced.withColumn("_slice", F.coalesce(part, F.lit(0))).drop("_slices")

    before = Window.partitionBy("feature", "level").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.where("_slice IS NOT NULL").groupBy("feature", "level", "_slice")
    totals = totals.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("p"))
    carry = totals.select(
        "feature", "level", "_slice",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_positives"),
    ).where("_rows > 0")
    inside = Window.partitionBy("feature", "level", "_slice").orderBy("_place", "_order").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({"_n": F.count(F.lit(1)).over(inside), "_p": F.coalesce(F.sum("_label").over(inside), F.lit(0))})
    joined = local.join(materialize(carry, "category-carry"), ["feature", "level", "_slice"], "left")
    rows = F.col("_n") + F.coalesce("_rows", F.lit(0))
    positives = F.col("_p") + F.coalesce("_positives", F.lit(0))
    return joined.select(
        F.col("_order").alias(order), "feature", "level", rows.alias("rows_before"), _smoothed(positives, rows, share, prior).alias("value")
    )


def category_totals(
    train: DataFrame, columns: Sequence[str], *, label: str = "label", prior: float = PRIOR
) -> tuple[DataFrame, float]:
    """``feature, level, value`` over all training rows, and the value of a level that they do not have."""
    share = label_share(train, label)
    counts = _tall(train, columns, F.col(label).cast("long").alias("_label")).groupBy("feature", "level")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("p"))
    return counts.select("feature", "level", _smoothed(F.col("p"), F.col("n"), share, prior).alias("value")), share


def _widened(df: DataFrame, tall: DataFrame, columns: Sequence[str], order: str, missing: float | None) -> DataFrame:
    values = tall.groupBy(F.col(order).alias("_order")).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{c}_share") for c in columns]
    )
    joined = df.join(values, F.col(order) == F.col("_order"), "left").drop("_order")
    return joined if missing is None else joined.fillna(missing, subset=[f"{c}_share" for c in columns])


def with_category_shares(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str], *, label: str = "label", order: str = "row_no"
) -> list[DataFrame]:
    """The training rows with ``<column>_share`` of the rows before them, and the other tables with that of all training rows."""
    out = [_widened(train, ordered_category_stats(train, columns, label=label, order=order), columns, order, None)]
    totals, unseen = category_totals(train, columns, label=label)
    totals = materialize(totals, "category-totals")  # of known size: broadcast only if small
    for df in others:
        tall = _tall(df, columns, F.col(order)).join(totals, ["feature", "level"])
        out.append(_widened(df, tall, columns, order, unseen))
    return out
