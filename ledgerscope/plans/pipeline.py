"""The whole job: prepare, score and report, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.risk import prediction_code, prediction_label, reasons_text, risk_reasons, risk_tier
from ledgerscope.operators.enrich import (
    definitive,
    derive_columns,
    enrich_with_flags,
    pending,
)
from ledgerscope.operators.evaluate import experiment_delta, reliability
from ledgerscope.operators.history import HistoryColumns, supplier_history
from ledgerscope.operators.learn import (
    Bundle,
    Candidate,
    calibrate,
    candidates,
    choose_threshold,
    compare_trained,
    final_evaluate,
    permutation_importance,
    pick_best,
    score_rows,
    train_experiments,
)
from ledgerscope.operators.ranks import exact_quantiles
from ledgerscope.operators.split import temporal_split
from ledgerscope.operators.trials import stored_models
from ledgerscope.sources.workspace import materialize

DEFAULT_CUTS = (0.30, 0.60)


def prepare(
    invoices: DataFrame,
    registry: DataFrame,
    flags: DataFrame | None = None,
    *,
    tie_break: str = "row_no",
    fill: str = "median",
    small: bool | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Derived columns, supplier history, registry fields and membership flags of every invoice.

    History comes first: its passes then read nothing but the invoice columns they need, and the
    one large shuffle does not carry the names and addresses of the registry.
    """
    featured = supplier_history(derive_columns(invoices), HistoryColumns(tie_break=tie_break), fill=fill)
    return enrich_with_flags(featured, registry, flags, small=small, check_unique=check_unique)


def risk_cuts(scored: DataFrame, score: str = "probability") -> tuple[float, float]:
    """Tier borders: exact 33 % and 85 % quantiles of the scores, or the defaults without scores."""
    cuts = exact_quantiles(scored, score, S.RISK_QUANTILES)
    return DEFAULT_CUTS if cuts[0] is None else (cuts[0], cuts[1])


def risk_cut_table(scored: DataFrame, score: str = "probability") -> DataFrame:
    return scored.sparkSession.createDataFrame([risk_cuts(scored, score)], "low_medium double, medium_high double")


def finish_predictions(
    scored: DataFrame,
    *,
    threshold: float,
    cuts: Sequence[float] = DEFAULT_CUTS,
    probability: str = "probability",
) -> DataFrame:
    """Code, label, tier and reasons for rows that carry a probability and the model features."""
    code = prediction_code(F.col(probability), threshold)
    reasons = risk_reasons(
        *[
            F.col(c)
            for c in ("key_status", "domicile", "irregular", "is_new_supplier", "prev_incident_rate", "amount_deviation")
        ]
    )
    return scored.withColumns(
        {
            "code": code,
            "label": prediction_label(code),
            "tier": risk_tier(F.col(probability), *cuts),
            "reason_list": reasons,
            "reasons": reasons_text(reasons),
        }
    )


# Identity of an invoice in the output; names and addresses only when the input has them.
OUTPUT_COLUMNS = (
    "invoice_id",
    "supplier_key",
    "legal_name",
    "doc_type",
    "issued_ts",
    "currency",
    "amount",
    "key_status",
    "domicile",
    "irregular",
)
OPTIONAL_OUTPUT = ("row_no", "supplier_name", "address", "location_code", *S.LIST_FLAGS)


def score_pending(pending_rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Probability, code, label, tier and reasons of pending invoices."""
    S.require_columns(pending_rows, (*bundle.features, *OUTPUT_COLUMNS), "scoring")
    scored = score_rows(bundle.pipeline, pending_rows, "probability")
    finished = finish_predictions(scored, threshold=bundle.threshold, cuts=bundle.cuts)
    extra = [c for c in OPTIONAL_OUTPUT if c in pending_rows.columns]
    return finished.select(*OUTPUT_COLUMNS, *extra, "probability", "code", "label", "tier", "reasons")


@dataclass
class Training:
    """What a training run leaves: the bundle, and tables on how it was chosen and how it does on the test rows."""

    bundle: Bundle
    comparison: DataFrame
    predictions: DataFrame
    calibration: DataFrame
    settings: list[tuple[str, str, dict]]
    left_out: list[tuple[str, str, str]]
    test_scores: DataFrame
    test_metrics: DataFrame
    reliability: str
    delta: DataFrame
    importance: DataFrame


def train(
    prepared: DataFrame,
    *,
    experiments: dict[str, Sequence[str]] | None = None,
    models: Sequence[Candidate] | None = None,
    search: bool = True,
    max_settings: int = 8,
    repeats: int = 5,
    store: str | None = None,
) -> Training:
    """Compare models in time order, calibrate the best, judge it on the test rows, and score the pending invoices.

    With a ``store`` and without a search, models are kept in that folder, and read from it by later runs on the same rows.
    """
    # Read by every fit of the comparison: written once, so that a lost executor does not bring the
    # whole preparation back.
    prepared = materialize(prepared, "prepared")
    labelled = temporal_split(definitive(prepared).withColumn("label", F.col("incident")))
    fit_rows, validation, test = (labelled.where(F.col("split") == s) for s in ("train", "validation", "test"))
    experiments = experiments or {"base": S.BASE_FEATURES, "extended": S.FULL_FEATURES}
    left_out: list[tuple[str, str, str]] = []
    if store is not None and not search:
        trained = stored_models(fit_rows, experiments, models or candidates(), store, left_out=left_out)
        comparison = compare_trained(trained, validation)
    else:
        trained, comparison = train_experiments(
            fit_rows, validation, experiments, models or candidates(), search=search, max_settings=max_settings, left_out=left_out
        )
    best, threshold = pick_best(trained, comparison)
    pipeline, calibration = calibrate(best.pipeline, validation)
    if calibration.where("selected AND method <> 'original'").count():
        threshold = choose_threshold(pipeline, validation)

    test_scores = materialize(score_rows(pipeline, test).select("label", "score"), "test-scores")
    test_metrics = final_evaluate(test_scores, threshold)
    known = {r["metric"]: r["value"] for r in test_metrics.collect()}  # one row per metric
    share = test_scores.agg(F.coalesce(F.avg(F.col("label").cast("double")), F.lit(0.0))).first()[0]
    # A constant score has the share of incidents as its average precision.
    verdict = test_scores.sparkSession.range(1).select(
        reliability(F.lit(known["pr_auc"]), F.lit(known["f1"]), F.lit(known["precision"]), share)
    ).first()[0]

    open_rows = pending(prepared)
    pending_scores = materialize(score_rows(pipeline, open_rows, "probability").select("probability"), "pending-scores")
    bundle = Bundle(pipeline, best.features, threshold, risk_cuts(pending_scores), best.experiment, best.model)
    names = list(experiments)
    return Training(
        bundle=bundle,
        comparison=comparison,
        predictions=score_pending(open_rows, bundle),
        calibration=calibration,
        settings=[(t.experiment, t.model, t.setting) for t in trained],
        left_out=left_out,
        test_scores=test_scores,
        test_metrics=test_metrics,
        reliability=verdict,
        delta=experiment_delta(comparison, names[0], names[-1]),
        importance=permutation_importance(pipeline, test, best.features, repeats=repeats),
    )


def train_and_score(prepared: DataFrame, **options) -> tuple[Bundle, DataFrame, DataFrame]:
    """The bundle, the comparison table and the predictions of a training run."""
    done = train(prepared, **options)
    return done.bundle, done.comparison, done.predictions
