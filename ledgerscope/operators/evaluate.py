"""Metrics of scored rows: exact ranking metrics, threshold tables and choices made from them.

Every function accepts ``within``: metrics per group (model, experiment, bootstrap round, ...) come
from one pass over all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope import schema as S
from ledgerscope.operators.ranks import exact_quantiles, running_totals
from ledgerscope.sources.workspace import materialize

FIRST_PERCENT, LAST_PERCENT = 5, 95
COMPARED = ("pr_auc", "f1", "recall", "precision", "false_positives", "false_negatives")
MIN_PR_AUC_GAIN = 0.005

# Reliability levels.
UNRELIABLE, LIMITED, USABLE, GOOD = "No confiable", "Limitada", "Aceptable para priorizacion", "Buena"
DUMMY_MODEL = "dummy"


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


# --------------------------------------------------------------------------- ranking metrics
def score_table(df: DataFrame, *, label: str = "label", score: str = "score", within: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; ties become one row on the map side."""
    return df.groupBy(*within, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def cumulative_scores(
    table: DataFrame,
    *,
    score: str = "score",
    within: Sequence[str] = (),
    slices: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """True and false positives when everything from this score upward is flagged."""
    totals = {"tp": F.col("pos"), "fp": F.col("neg")}
    return running_totals(table, score, totals, within=within, slices=slices, cuts=cuts)


def ranking_metrics(cumulative: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Average precision (by steps) and ROC area (ties count half), per group."""
    pos, neg = F.sum("pos"), F.sum("neg")
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    # Decimal products: exact, and large enough for pairs of very many rows.
    ranked_above = F.sum(F.col("neg").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)"))
    return cumulative.groupBy(*within).agg(
        F.try_divide(F.sum(F.col("pos") * precision), pos).alias("pr_auc"),
        F.try_divide(ranked_above.cast("double"), 2.0 * pos.cast("double") * neg.cast("double")).alias("roc_auc"),
    )


def ranking_report(df: DataFrame, *, label: str = "label", score: str = "score", within: Sequence[str] = ()) -> DataFrame:
    """The ranking metrics of every group. Its distinct scores are written first: several passes read them, and a model scores each row once."""
    table = materialize(score_table(df, label=label, score=score, within=within), "ranking-scores")
    return ranking_metrics(cumulative_scores(table, score=score, within=within), within)


def curve_points(df: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """Precision-recall and ROC points, one per distinct score."""
    totals = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    points = cumulative_scores(score_table(df, label=label, score=score), score=score)
    return points.select(
        score,
        "tp",
        "fp",
        _or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _or_zero(F.col("tp"), F.lit(totals["p"])).alias("recall"),
        _or_zero(F.col("fp"), F.lit(totals["n"])).alias("false_positive_rate"),
    )


def calibration_bins(df: DataFrame, bins: int = 10, *, label: str = "label", score: str = "score") -> DataFrame:
    """Mean score and share of positives per quantile bin; empty bins are left out."""
    edges = exact_quantiles(df, score, [i / bins for i in range(1, bins)])
    bin_id = F.lit(0)
    for edge in edges:
        bin_id = bin_id + F.when(F.col(score) > F.lit(edge), 1).otherwise(0)
    return df.groupBy(bin_id.alias("bin")).agg(
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("n"),
    )


def brier(df: DataFrame, *, label: str = "label", score: str = "score", within: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*within).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


# --------------------------------------------------------------------------- thresholds
def _derived_metrics(table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Metrics from the four cells; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)
    real = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    mcc_top = real["tp"] * real["tn"] - real["fp"] * real["fn"]
    mcc_root = F.sqrt(
        (real["tp"] + real["fp"]) * (real["tp"] + real["fn"]) * (real["tn"] + real["fp"]) * (real["tn"] + real["fn"])
    )
    return table.select(
        *keep,
        tn.alias("true_negatives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        tp.alias("true_positives"),
        _or_zero(tp + tn, n).alias("accuracy"),
        # The mean over the classes that occur.
        F.coalesce((recall + specificity) / 2, recall, specificity, F.lit(0.0)).alias("balanced_accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        F.coalesce(recall, F.lit(0.0)).alias("recall"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.coalesce(specificity, F.lit(0.0)).alias("specificity"),
        F.coalesce(F.try_divide(mcc_top, mcc_root), F.lit(0.0)).alias("mcc"),
        (100 * _or_zero(tp + fp, n)).alias("flagged_pct"),
    )


def confusion_metrics(
    df: DataFrame, threshold: float | Column, *, label: str = "label", score: str = "score", within: Sequence[str] = ()
) -> DataFrame:
    """Confusion cells and the metrics derived from them at one threshold, in one aggregate."""
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    cells = df.groupBy(*within).agg(
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    )
    return _derived_metrics(cells, within)


def threshold_sweep(
    df: DataFrame, *, label: str = "label", score: str = "score", within: Sequence[str] = ()
) -> DataFrame:
    """Metrics at the thresholds 0.05, 0.06, ..., 0.95.

    Each score is reduced to the highest threshold it passes. The table of thresholds is then short
    (91 rows per group), whatever the number of scored rows.
    """
    value = F.col(score)
    guess = F.floor(value * 100).cast("int")
    # floor() may be one off next to a threshold, so the neighbours are compared as written (k / 100).
    passed = (
        F.when((guess + 1) / F.lit(100.0) <= value, guess + 1).when(guess / F.lit(100.0) > value, guess - 1).otherwise(guess)
    )
    percent = F.greatest(F.least(passed, F.lit(LAST_PERCENT)), F.lit(FIRST_PERCENT - 1))
    counted = df.groupBy(*within, percent.alias("percent")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    every = (
        counted.select(*within).distinct()
        .withColumn("percent", F.explode(F.sequence(F.lit(FIRST_PERCENT - 1), F.lit(LAST_PERCENT))))
        .withColumns({"pos": F.lit(0).cast("bigint"), "neg": F.lit(0).cast("bigint")})
        if within
        else df.sparkSession.range(FIRST_PERCENT - 1, LAST_PERCENT + 1).select(
            F.col("id").cast("int").alias("percent"),
            F.lit(0).cast("bigint").alias("pos"),
            F.lit(0).cast("bigint").alias("neg"),
        )
    )
    full = counted.unionByName(every).groupBy(*within, "percent").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    upward = Window.partitionBy(*within).orderBy(F.desc("percent")).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*within)
    cells = full.select(
        *within,
        "percent",
        F.sum("pos").over(upward).alias("tp"),
        F.sum("neg").over(upward).alias("fp"),
        F.sum("pos").over(group).alias("p"),
        F.sum("neg").over(group).alias("n"),
    ).where(F.col("percent") >= FIRST_PERCENT)
    cells = cells.withColumns(
        {"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp"), "threshold": F.col("percent") / F.lit(100.0)}
    )
    metrics = _derived_metrics(cells, [*within, "threshold"])
    return metrics.select(
        *within, "threshold", "precision", "recall", "f1", "balanced_accuracy", "false_positives", "false_negatives",
        "flagged_pct",
    )


def select_threshold(sweep: DataFrame, min_recall: float = S.MIN_RECALL, within: Sequence[str] = ()) -> DataFrame:
    """Best F1 (then precision, then the lower threshold) among thresholds with enough recall.

    Without any such threshold the best F1 of all is taken; ``recall_reached`` tells which.
    """
    reached = F.col("recall") >= min_recall
    order = F.struct(
        reached.alias("recall_reached"),
        F.col("f1"),
        F.when(reached, F.col("precision")).otherwise(F.lit(0.0)).alias("tie"),
        (-F.col("threshold")).alias("low_first"),
    )
    best = F.max_by(F.struct("threshold", reached.alias("recall_reached"), "f1", "precision", "recall"), order)
    return sweep.groupBy(*within).agg(best.alias("best")).select(*within, "best.*")


# --------------------------------------------------------------------------- model comparison
def model_table(df: DataFrame, within: Sequence[str] = ("experiment", "model"), **columns: str) -> DataFrame:
    """One row per model with the chosen threshold and every metric at it."""
    chosen = select_threshold(threshold_sweep(df, within=within, **columns), within=within)
    chosen = chosen.select(*within, "threshold", "recall_reached")
    at_threshold = df.join(F.broadcast(chosen), list(within))  # one row per trained model
    confusion = confusion_metrics(at_threshold, F.col("threshold"), within=[*within, "threshold"], **columns)
    ranking = ranking_report(df, within=within, **columns)
    return confusion.join(ranking, list(within)).join(brier(df, within=within, **columns), list(within))


def select_best(models: DataFrame) -> DataFrame:
    """Best model by average precision, then F1, then recall; the dummy never wins."""
    ranked = models.where(F.col("model") != DUMMY_MODEL)
    return ranked.orderBy(F.desc("pr_auc"), F.desc("f1"), F.desc("recall"), "experiment", "model").limit(1)


def experiment_delta(models: DataFrame, base: str, extended: str) -> DataFrame:
    """What the extended experiment adds per model: both values, absolute and percent change, verdict."""

    def of(experiment: str, metric: str) -> Column:
        return F.max(F.when(F.col("experiment") == experiment, F.col(metric)))

    wide = (
        models.where(F.col("experiment").isin(base, extended))
        .groupBy("model")
        .agg(
            F.count_distinct("experiment").alias("_experiments"),
            *[of(base, m).alias(f"{m}_base") for m in COMPARED],
            *[of(extended, m).alias(f"{m}_extended") for m in COMPARED],
        )
        .where(F.col("_experiments") == 2)
    )
    columns: list[Column] = [F.col("model")]
    for m in COMPARED:
        before, after = F.col(f"{m}_base"), F.col(f"{m}_extended")
        delta = after - before
        columns += [before, after, delta.alias(f"{m}_delta")]
        columns.append(F.try_divide(delta.cast("double") * 100, F.abs(before).cast("double")).alias(f"{m}_delta_pct"))
    adds = (F.col("pr_auc_delta") > MIN_PR_AUC_GAIN) & (F.col("f1_delta") > 0)
    # The two verdicts.
    verdict = F.when(adds, "aporta").otherwise("aporte_minimo_o_negativo")
    return wide.select(*columns).withColumn("verdict", verdict)


def reliability(pr_auc: Column, f1: Column, precision: Column, dummy_pr_auc: Column | float) -> Column:
    dummy = dummy_pr_auc if isinstance(dummy_pr_auc, Column) else F.lit(dummy_pr_auc)
    return (
        F.when((pr_auc <= dummy * 1.05) | (f1 < 0.12), UNRELIABLE)
        .when((f1 < 0.30) | (precision < 0.20), LIMITED)
        .when(f1 < 0.50, USABLE)
        .otherwise(GOOD)
    )
