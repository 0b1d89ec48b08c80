"""Exact order statistics and running totals without a single-task sort.

``percentile`` keeps every distinct value of a group in one task and a window without partition
sorts everything in one task. Both are used here only below a checked size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL_ROWS = 1_000_000
#: The values of all columns together that ``percentile`` may see: it brings them to one task.
SMALL_VALUES = 4_000_000
HISTOGRAM_BINS = 4096
#: Accuracy of the sketches that brackets start from, and how many times its inverse they reach to both sides.
SKETCH, SKETCH_MARGIN = 10_000, 4
SLICES, SLICE_ROWS = 256, 1_000_000


@dataclass
class _Bracket:
    """Where the value at a rank lies: between two values that occur, ``rank`` places after the lower one."""

    column: str
    rank: int
    low: object
    high: object
    rows: int

    def bin_of(self, bins: int) -> Column:
        """The bin of a row inside the bracket; null outside. Few rows get a bin per value."""
        value = F.col(self.column)
        if self.rows <= bins:
            at = value.cast("double")
        else:
            width = float(self.high) - float(self.low)
            position = (value.cast("double") - F.lit(float(self.low))) / F.lit(width) * bins
            at = F.least(F.greatest(F.floor(position), F.lit(0)), F.lit(bins - 1)).cast("double")
        return F.when(value.between(F.lit(self.low), F.lit(self.high)), at)

    def narrowed(self, table: Sequence) -> None:
        for row in sorted(table, key=lambda r: r["lo"]):
            if self.rank < row["n"]:
                self.low, self.high, self.rows = row["lo"], row["hi"], row["n"]
                return
            self.rank -= row["n"]


def _sketched(df: DataFrame, found: Mapping[tuple[str, int], _Bracket]) -> None:
    """Start brackets near their ranks: quantile sketches propose both ends, and exact counts decide whether the rank is between them."""
    margin = SKETCH_MARGIN / SKETCH
    open_ = [b for b in found.values() if b.low < b.high]
    shares = [(max(b.rank / b.rows - margin, 0.0), min((b.rank + 1) / b.rows + margin, 1.0)) for b in open_]
    ends = [F.percentile_approx(b.column, F.array(*map(F.lit, s)), F.lit(SKETCH)) for b, s in zip(open_, shares, strict=True)]
    if not open_:
        return
    proposed = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    inside = [F.col(b.column).between(F.lit(lo), F.lit(hi)) for b, (lo, hi) in zip(open_, proposed, strict=True)]
    below = [F.col(b.column) < F.lit(lo) for b, (lo, _) in zip(open_, proposed, strict=True)]
    counts = df.agg(*[F.struct(F.count_if(u).alias("below"), F.count_if(i).alias("inside")).alias(f"c{k}") for k, (u, i) in enumerate(zip(below, inside, strict=True))]).first()
    for b, (lo, hi), n in zip(open_, proposed, counts, strict=True):
        if n["below"] <= b.rank < n["below"] + n["inside"]:
            b.low, b.high, b.rank, b.rows = lo, hi, b.rank - n["below"], n["inside"]


def values_at_ranks_of(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], bins: int = HISTOGRAM_BINS
) -> dict[str, dict[int, object]]:
    """Exact values at zero-based ranks of several numeric columns of one type; nulls are not counted.

    All ranks are narrowed together: brackets start at sketches of the quantiles, so that few rows are inside; then each pass is one
    aggregate over the table, which puts the rows of every open bracket into at most ``bins`` bins and brings those to the driver. Bin borders are computed in one
    monotone expression and the new bracket is made of values that occur, so the answer is exact
    whatever the rounding.
    """
    columns = list(ranks)
    stats = df.agg(
        *[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]
    ).first()
    found = {
        (c, r): _Bracket(c, r, stats[c]["lo"], stats[c]["hi"], stats[c]["n"]) for c in columns for r in set(ranks[c])
    }
    _sketched(df, found)
    while open_ := [(k, b) for k, b in found.items() if b.low < b.high]:
        same: dict[tuple, int] = {}
        for _, b in open_:
            same.setdefault((b.column, b.low, b.high), len(same))
        shown = {same[b.column, b.low, b.high]: b for _, b in open_}
        entries = [
            F.when(
                b.bin_of(bins).isNotNull(),
                F.struct(F.lit(i).alias("bracket"), b.bin_of(bins).alias("bin"), F.col(b.column).alias("value")),
            )
            for i, b in shown.items()
        ]
        rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        table = (
            rows.groupBy("e.bracket", "e.bin")
            .agg(F.min("e.value").alias("lo"), F.max("e.value").alias("hi"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for _, b in open_:
            b.narrowed([r for r in table if r["bracket"] == same[b.column, b.low, b.high]])
    return {c: {r: found[c, r].low for r in ranks[c]} for c in columns}


def values_at_ranks(df: DataFrame, value: str, ranks: Sequence[int], bins: int = HISTOGRAM_BINS) -> list:
    """Exact values at zero-based ranks of a numeric column; nulls are not counted."""
    found = values_at_ranks_of(df.select(value), {value: ranks}, bins)[value]
    return [found[r] for r in ranks]


def exact_quantiles_of(
    df: DataFrame,
    quantiles: Mapping[str, Sequence[float]],
    small_rows: int = SMALL_ROWS,
    bins: int = HISTOGRAM_BINS,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, with linear interpolation between neighbours.

    Columns of up to ``small_rows`` values, and of ``SMALL_VALUES`` together, have them from the built-in ``percentile``, all in one
    aggregate; of the longer ones, the two neighbours of each quantile are selected by histogram passes for all together.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in quantiles])
    counts = df.agg(*[F.count(c).alias(c) for c in quantiles]).first()
    result: dict[str, list[float | None]] = {c: [None] * len(qs) for c, qs in quantiles.items()}
    short = [c for c in quantiles if 0 < counts[c] <= small_rows]
    if sum(counts[c] for c in short) > SMALL_VALUES:
        short = []
    if short:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in quantiles[c]])).alias(c) for c in short]).first()
        result |= {c: list(row[c]) for c in short}
    long = {c: [(counts[c] - 1) * q for q in quantiles[c]] for c in quantiles if counts[c] and c not in short}
    if long:
        ranks = {c: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))}) for c, ps in long.items()}
        at = values_at_ranks_of(df, ranks, bins)
        for c, positions in long.items():
            result[c] = []
            for p in positions:
                low, high, share = at[c][math.floor(p)], at[c][math.ceil(p)], p - math.floor(p)
                result[c].append((math.ceil(p) - p) * low + share * high if share else low)
    return result


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    small_rows: int = SMALL_ROWS,
    bins: int = HISTOGRAM_BINS,
) -> list[float | None]:
    """Exact quantiles of one column, with linear interpolation between neighbours; ``None`` without values."""
    return exact_quantiles_of(df, {value: quantiles}, small_rows, bins)[value]


def rows_at_ranks(
    df: DataFrame, first: str, second: str, ranks: Sequence[int], small_rows: int = SMALL_ROWS
) -> list[tuple | None]:
    """The (first, second) pairs at zero-based ranks of the order by both; None beyond the end.

    Both columns are integers without nulls. A short table is ranked by a window; a long one by
    selecting on ``first``, then on ``second`` among the rows that tie.
    """
    df = df.select(first, second)
    n = df.count()
    inside = sorted({r for r in ranks if 0 <= r < n})
    found: dict[int, tuple] = {}
    if inside and n <= small_rows:
        rank = F.row_number().over(Window.orderBy(first, second)) - 1
        ranked = df.withColumn("_rank", rank).where(F.col("_rank").isin(inside))
        found = {row["_rank"]: (row[first], row[second]) for row in ranked.collect()}
    elif inside:
        for r, at in zip(inside, values_at_ranks(df, first, inside), strict=True):
            before = df.where(F.col(first) < at).count()
            ties = df.where(F.col(first) == at)
            found[r] = (at, values_at_ranks(ties, second, [r - before])[0])
    return [found.get(r) for r in ranks]


def cut_points(df: DataFrame, value: str, slices: int | None = None) -> list[float]:
    """Increasing values that cut a numeric column into about equal parts; at most ``slices - 1``.

    Without ``slices`` there are ``SLICES``, and more where a slice would have more than ``SLICE_ROWS`` rows.
    """
    if slices is None:
        slices = max(SLICES, -(-df.count() // SLICE_ROWS))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(slices * 50)).alias("q")).first()
    return sorted(set(row["q"] or []))


def running_totals(
    df: DataFrame,
    value: str,
    totals: dict[str, Column],
    *,
    within: Sequence[str] = (),
    descending: bool = True,
    slices: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add running totals (current row included) in the order of ``value`` over the whole table.

    ``value`` must be unique within each group, as after ``groupBy(value)``. The order is cut into
    slices at approximate quantiles. Each slice is summed by its own task and starts from the total
    of the slices before it; the table of slice totals has at most ``slices`` rows per group. Cuts that are
    already known can be given.
    """
    if cuts is None:
        cuts = cut_points(df, value, slices)
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        numbered = df.withColumn("_value", F.col(value).cast("double"))
        sliced = Bucketizer(splits=splits, inputCol="_value", outputCol="_slice").transform(numbered).drop("_value")
    else:
        sliced = df.withColumn("_slice", F.lit(0.0))
    sliced = sliced.withColumns({f"_{name}": expr for name, expr in totals.items()})

    def direction(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    group = list(within)
    before = Window.partitionBy(*group).orderBy(direction("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*group, "_slice")
        .agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in totals])
        .select(*group, "_slice", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in totals])
    )
    inside = (
        Window.partitionBy(*group, "_slice").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.withColumns({name: F.sum(f"_{name}").over(inside) for name in totals})
    joined = local.join(carry, [*group, "_slice"])
    return joined.withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in totals}).select(
        *df.columns, *totals
    )
