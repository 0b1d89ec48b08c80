"""Supplier history: features of an invoice computed only from earlier invoices of its supplier.

Invoices of a supplier are ordered by issue time (missing times last) and then by an explicit tie
break. A supplier of ordinary size is one window group. A hot supplier is cut along that order into
slices: each slice is a window group of its own and starts from the totals of the slices before it,
so results do not depend on how the supplier is cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope import schema as S
from ledgerscope.functions.temporal import MICROS_PER_DAY, whole_days
from ledgerscope.operators.ranks import exact_quantiles
from ledgerscope.operators.skew import HOT_KEY_ROWS, HotKeys, hot_keys, null_safe_key

MONEY = "decimal(38,6)"


def money(amount: Column) -> Column:
    """An exact amount, so that sums do not depend on partitioning; null if it is too large or not a number."""
    return amount.try_cast(MONEY)

MAX_SLICES = 4096  # per supplier
MAX_CUTS = 20_000  # over all hot suppliers, besides one cut each
SAMPLES_PER_SLICE = 16
LAST = (1 << 63) - 1  # stands for a missing issue time: after every real one
FIRST = -(1 << 63)


@dataclass(frozen=True)
class HistoryColumns:
    key: str = "supplier_key"
    issued: str = "issued_ts"
    tie_break: str = "row_no"
    amount: str = "amount"
    incident: str = "incident"


# --------------------------------------------------------------------------- global prior
def daily_prior(df: DataFrame, issued: str = "issued_ts", incident: str = "incident") -> DataFrame:
    """Incident rate of all strictly earlier days, one row per day, plus the rate for a missing day.

    There is one row per calendar day, so the window over all rows is small however long the table.
    The row with a null day carries the rate of the last day.
    """
    daily = (
        df.where(F.col(issued).isNotNull())
        .groupBy(F.to_date(issued).alias("day"))
        .agg(
            F.coalesce(F.sum(F.col(incident).cast("bigint")), F.lit(0)).alias("incidents"),
            F.count(incident).alias("known"),
        )
    )
    by_day = Window.orderBy("day")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    rates = daily.select(
        "day",
        F.coalesce(F.sum("incidents").over(earlier), F.lit(0)).alias("prior_incidents"),
        F.coalesce(F.sum("known").over(earlier), F.lit(0)).alias("prior_known"),
        F.lead("day").over(by_day).isNull().alias("is_last"),
    ).withColumn("prior_rate", F.coalesce(F.try_divide("prior_incidents", "prior_known"), F.lit(0.0)))
    days = F.when(F.col("is_last"), F.array("day", F.lit(None).cast("date"))).otherwise(F.array("day"))
    return rates.select(F.explode(days).alias("day"), "prior_incidents", "prior_known", "prior_rate")


# --------------------------------------------------------------------------- ordinary suppliers
def _whole_supplier_windows(rows: DataFrame, windows: Sequence[int]) -> DataFrame:
    """All history sums with one shuffle and one sort: every window shares its sort prefix."""
    order = [F.col("_at").asc(), F.col("_tie").asc()]
    by_order = Window.partitionBy("_key").orderBy(*order)
    before = by_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_n": (F.row_number().over(by_order) - 1).cast("bigint"),
            "_inc": F.sum("_incident").over(before),
            "_known": F.count("_incident").over(before),
            "_amt_sum": F.sum("_amount").over(before),
            "_amt_n": F.count("_amount").over(before),
            "_amt_max": F.max("_amount").over(before),
            "_prev_at": F.lag("_at").over(by_order),
        }
    )
    by_time = Window.partitionBy("_key").orderBy(F.col("_at").asc())
    older = {}
    for days in windows:
        frame = by_time.rangeBetween(Window.unboundedPreceding, -(days * MICROS_PER_DAY + 1))
        older[f"_n_older_{days}"] = F.count(F.lit(1)).over(frame)
        older[f"_inc_older_{days}"] = F.sum("_incident").over(frame)
    return rows.withColumns(older)


# --------------------------------------------------------------------------- hot suppliers
def _slice_borders(rows: DataFrame, hot: HotKeys, slice_rows: int) -> DataFrame:
    """Where to cut each hot supplier: a short list of positions from a hash sample.

    The sample only chooses the cuts; no row is dropped. The list has at most ``MAX_CUTS`` entries
    plus one or two per hot supplier. It is collected once, so that every branch of the plan, and
    every retry of a task, sees the same cuts.
    """
    spark = rows.sparkSession
    slice_rows = max(slice_rows, sum(hot.rows.values()) // MAX_CUTS)
    spec = []
    for key, n in hot.rows.items():
        slices = max(2, min(MAX_SLICES, math.ceil(n / slice_rows)))
        spec.append((key, slices, max(1, n // (slices * SAMPLES_PER_SLICE))))
    spec_table = F.broadcast(spark.createDataFrame(spec, "_key string, slices int, stride bigint"))
    sample = (
        rows.join(spec_table, "_key")
        .where(F.pmod(F.xxhash64("_tie"), F.col("stride")) == 0)
        .groupBy("_key", "slices")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_tie"))).alias("positions"))
        .withColumn("step", F.greatest(F.lit(1), F.floor(F.size("positions") / F.col("slices"))))
        .select("_key", F.expr("filter(positions, (p, i) -> i > 0 AND i % step = 0)").alias("cuts"))
        .collect()
    )
    borders = []
    for row in sample:
        cuts = [(p["_at"], p["_tie"]) for p in row["cuts"]]
        block = max(1, math.isqrt(len(cuts)))
        blocks = [cuts[i : i + block] for i in range(0, len(cuts), block)]
        borders.append((row["_key"], [b[0] for b in blocks], blocks))
    missing = set(hot.rows) - {key for key, _, _ in borders}
    borders.extend((key, [], []) for key in missing)
    position = "struct<at:bigint,tie:bigint>"
    return spark.createDataFrame(
        borders, f"_key string, _coarse array<{position}>, _fine array<array<{position}>>"
    )


def _slice_of(at: Column, tie: Column) -> Column:
    """Number of cuts at or before a position, found in two steps over short arrays."""
    here = F.struct(at.alias("at"), tie.alias("tie"))
    blocks = F.size(F.filter("_coarse", lambda cut: cut <= here))
    block_size = F.size(F.try_element_at("_fine", F.lit(1)))
    within = F.size(F.filter(F.try_element_at("_fine", F.greatest(blocks, F.lit(1))), lambda cut: cut <= here))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * block_size + within)


def _sliced_supplier_windows(rows: DataFrame, borders: DataFrame, windows: Sequence[int]) -> DataFrame:
    """The sums of ``_whole_supplier_windows`` for suppliers cut into slices."""
    original = rows.columns
    rows = rows.join(F.broadcast(borders), "_key").withColumn("_slice", _slice_of(F.col("_at"), F.col("_tie")))

    # Totals of the slices before each slice; at most about MAX_SLICES rows per supplier.
    totals = rows.groupBy("_key", "_slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_incident").alias("inc"),
        F.count("_incident").alias("known"),
        F.sum("_amount").alias("amt_sum"),
        F.count("_amount").alias("amt_n"),
        F.max("_amount").alias("amt_max"),
        F.max("_at").alias("at"),
    )
    slices = Window.partitionBy("_key").orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_key",
        "_slice",
        *[F.sum(c).over(earlier).alias(f"c_{c}") for c in ("n", "inc", "known", "amt_sum", "amt_n")],
        F.max("amt_max").over(earlier).alias("c_amt_max"),
        F.lag("at").over(slices).alias("c_at"),
    )

    def plus(local: Column, carried: str) -> Column:
        return F.when(
            local.isNotNull() | F.col(carried).isNotNull(),
            F.coalesce(local, F.lit(0)) + F.coalesce(F.col(carried), F.lit(0)),
        )

    order = Window.partitionBy("_key", "_slice").orderBy("_at", "_tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns(
        {
            "_n": (F.row_number().over(order) - 1).cast("bigint"),
            "_inc": F.sum("_incident").over(before),
            "_known": F.count("_incident").over(before),
            "_amt_sum": F.sum("_amount").over(before),
            "_amt_n": F.count("_amount").over(before),
            "_amt_max": F.max("_amount").over(before),
            "_prev_at": F.lag("_at").over(order),
        }
    )
    local = local.join(carry, ["_key", "_slice"]).withColumns(
        {
            "_n": plus(F.col("_n"), "c_n"),
            "_inc": plus(F.col("_inc"), "c_inc"),
            "_known": plus(F.col("_known"), "c_known"),
            "_amt_sum": plus(F.col("_amt_sum"), "c_amt_sum"),
            "_amt_n": plus(F.col("_amt_n"), "c_amt_n"),
            "_amt_max": F.greatest("_amt_max", "c_amt_max"),
            "_prev_at": F.coalesce("_prev_at", "c_at"),
        }
    )

    # Rows older than N days: look the moment "N days ago" up among the distinct issue times.
    ticks = (
        rows.where(F.col("_at") < LAST)
        .groupBy("_key", "_slice", "_at")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_incident").alias("inc"))
    )
    lookups = (
        ticks.withColumn("days", F.explode(F.array(*[F.lit(d) for d in windows])))
        .select("_key", F.col("_slice").alias("from_slice"), F.col("_at").alias("from_at"), "days")
        .withColumn("_at", F.col("from_at") - F.col("days") * F.lit(MICROS_PER_DAY))
        .join(F.broadcast(borders), "_key")
        .withColumn("_slice", _slice_of(F.col("_at"), F.lit(FIRST)))
        .drop("_coarse", "_fine")
    )
    older = Window.partitionBy("_key", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    found = (
        ticks.unionByName(lookups, allowMissingColumns=True)
        .withColumns({"n": F.sum("n").over(older), "inc": F.sum("inc").over(older)})
        .where(F.col("days").isNotNull())
        .join(carry.select("_key", "_slice", "c_n", "c_inc"), ["_key", "_slice"], "left")
        .groupBy("_key", F.col("from_slice").alias("_slice"), F.col("from_at").alias("_at"))
        .agg(
            *[
                F.sum(F.when(F.col("days") == d, F.coalesce(v, F.lit(0)) + F.coalesce(f"c_{v}", F.lit(0)))).alias(
                    f"_{v}_older_{d}"
                )
                for d in windows
                for v in ("n", "inc")
            ]
        )
    )
    sums = ["_n", "_inc", "_known", "_amt_sum", "_amt_n", "_amt_max", "_prev_at"]
    olds = [f"_{v}_older_{d}" for d in windows for v in ("n", "inc")]
    return local.join(found, ["_key", "_slice", "_at"], "left").select(*original, *sums, *olds)


# --------------------------------------------------------------------------- public operator
def supplier_history(
    df: DataFrame,
    columns: HistoryColumns = HistoryColumns(),
    *,
    windows: Sequence[int] = S.HISTORY_WINDOWS,
    smoothing: float = S.SMOOTHING,
    fill: str = "median",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add the twelve history features to every invoice, null supplier keys included.

    ``tie_break`` is an integer column that is unique per row; it stands for the original row order.
    ``fill="median"`` fills the amounts of a supplier without past by the median of all amounts;
    ``fill="past_mean"`` uses the mean amount of earlier days only, so no later invoice has any say.
    """
    S.require_columns(
        df, (columns.key, columns.issued, columns.tie_break, columns.amount, columns.incident), "supplier history"
    )
    if fill not in ("median", "past_mean"):
        raise ValueError(f"unknown fill: {fill}")
    micros = F.unix_micros(F.col(columns.issued).cast("timestamp"))
    rows = df.withColumns(
        {
            "_key": null_safe_key(F.col(columns.key)),
            "_at": F.coalesce(micros, F.lit(LAST)),
            "_tie": F.col(columns.tie_break).cast("bigint"),
            "_amount": money(F.col(columns.amount)),
            "_incident": F.col(columns.incident).cast("bigint"),
        }
    )
    hot = hot_keys(rows.select("_key"), "_key", hot_rows)
    if hot:
        hot_list = F.broadcast(hot.table(rows, "_key").select("_key"))
        hot_part = rows.join(hot_list, "_key", "left_semi")
        borders = _slice_borders(hot_part, hot, hot_rows)
        summed = _whole_supplier_windows(rows.join(hot_list, "_key", "left_anti"), windows).unionByName(
            _sliced_supplier_windows(hot_part, borders, windows)
        )
    else:
        summed = _whole_supplier_windows(rows, windows)

    # At most one row per calendar day (plus one), so the broadcast cannot grow with the invoices.
    prior = daily_prior(df, columns.issued, columns.incident).select(F.col("day").alias("_day"), "prior_rate")
    summed = summed.withColumn("_day", F.to_date(columns.issued))
    summed = (
        summed.alias("r")
        .join(F.broadcast(prior.alias("p")), F.col("r._day").eqNullSafe(F.col("p._day")), "left")
        .drop(F.col("p._day"))
    )
    if fill == "median":
        median = exact_quantiles(df, columns.amount, [0.5])[0]
        no_past = F.lit(0.0 if median is None else median)
    else:
        summed, no_past = _with_past_mean(summed, df, columns)

    has_time = F.col("_at") < LAST
    previous = F.when(F.col("_prev_at") < LAST, F.timestamp_micros("_prev_at"))
    known_incidents = F.coalesce("_inc", F.lit(0))
    features: dict[str, Column] = {
        "prev_count": F.col("_n"),
        "prev_incidents": known_incidents,
        "prev_incident_rate": (known_incidents + F.coalesce("prior_rate", F.lit(0.0)) * smoothing)
        / (F.coalesce("_known", F.lit(0)) + F.lit(smoothing)),
        "prev_mean_amount": F.coalesce(F.try_divide(F.col("_amt_sum").cast("double"), F.col("_amt_n")), no_past),
        "prev_max_amount": F.coalesce(F.col("_amt_max").cast("double"), no_past),
        "days_since_prev": F.coalesce(
            F.when(has_time, whole_days(F.col(columns.issued).cast("timestamp"), previous)),
            F.lit(S.NO_PREVIOUS_DAYS),
        ),
        "is_new_supplier": (F.col("_n") == 0).cast("int"),
    }
    for days in windows:
        features[f"invoices_{days}d"] = F.when(has_time, F.col("_n") - F.col(f"_n_older_{days}")).otherwise(0)
        features[f"incidents_{days}d"] = F.when(
            has_time, known_incidents - F.coalesce(f"_inc_older_{days}", F.lit(0))
        ).otherwise(0)
    result = summed.withColumns(features)
    deviation = F.coalesce(F.col(columns.amount) - F.col("prev_mean_amount"), F.lit(0.0))
    result = result.withColumn("amount_deviation", deviation)
    return result.select(*df.columns, *features, "amount_deviation")


def _with_past_mean(rows: DataFrame, df: DataFrame, columns: HistoryColumns) -> tuple[DataFrame, Column]:
    """Attach the mean amount of all strictly earlier days (of all days for a missing date)."""
    daily = df.groupBy(F.to_date(columns.issued).alias("_day")).agg(
        F.try_sum(money(F.col(columns.amount))).alias("s"), F.count(money(F.col(columns.amount))).alias("n")
    )
    earlier = Window.orderBy(F.col("_day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    means = daily.select(
        "_day",
        F.coalesce(
            F.try_divide(F.sum("s").over(earlier).cast("double"), F.sum("n").over(earlier)), F.lit(0.0)
        ).alias("_past_mean"),
    )
    joined = rows.alias("r").join(
        F.broadcast(means.alias("m")), F.col("r._day").eqNullSafe(F.col("m._day")), "left"
    )
    return joined.drop(F.col("m._day")), F.coalesce("_past_mean", F.lit(0.0))


def leakage_report(history: DataFrame, incident: str = "incident") -> DataFrame:
    """Rows, share of known incidents and number of invoices of new suppliers, in one pass."""
    return history.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.try_divide(F.sum(F.col(incident).cast("bigint")), F.count(incident)), F.lit(0.0)).alias(
            "global_rate"
        ),
        F.sum(F.col("is_new_supplier").cast("bigint")).alias("new_supplier_rows"),
    )
