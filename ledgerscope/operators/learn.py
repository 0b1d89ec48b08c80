"""Training, calibration and scoring with MLlib.

Every fit is a distributed job over a persisted DataFrame. The driver only loops over settings and
sees one metric row per setting.
"""

from __future__ import annotations

import itertools
import logging
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators.evaluate import (
    DUMMY_MODEL,
    brier,
    confusion_metrics,
    model_table,
    ranking_report,
    select_best,
    select_threshold,
    threshold_sweep,
)
from ledgerscope.operators.ranks import exact_quantiles_of
from ledgerscope.operators.resample import bootstrap_ci, permuted_pieces
from ledgerscope.operators.split import expanding_folds
from ledgerscope.sources.workspace import exists, materialize

log = logging.getLogger(__name__)

FEATURES, WEIGHT, SCORE = "_features", "_class_weight", "score"
MAX_SETTINGS, FOLDS = 8, 3
MIN_KEPT_PR_AUC = 0.97
#: What a wrong family or setting raises before any job runs; failing jobs raise other errors.
UNUSABLE = (IllegalArgumentException, AttributeError, TypeError, ValueError)
UNLIMITED_DEPTH = 30  # the most that MLlib allows


# --------------------------------------------------------------------------- preprocessing
def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column (the smallest one on ties), for all columns in one job."""
    if not columns:
        return {}
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(entries)).where(F.col("v").isNotNull()).groupBy("c", "v").count()
    top = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
    return {row["c"]: row["v"] for row in top.collect()}  # one row per column


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns together; 0 for a column without values."""
    if not columns:
        return {}
    found = exact_quantiles_of(df, dict.fromkeys(columns, (0.5,)))
    return {c: 0.0 if found[c][0] is None else float(found[c][0]) for c in columns}


@dataclass(frozen=True)
class Fills:
    """What stands for a missing value: the mode of a category, the median of a number."""

    modes: Mapping[str, str]
    medians: Mapping[str, float]


def find_fills(train: DataFrame, features: Sequence[str], categorical: Sequence[str] = S.CATEGORICAL_FEATURES) -> Fills:
    return Fills(_modes(train, [f for f in features if f in categorical]), _medians(train, [f for f in features if f not in categorical]))


def fit_preprocessor(
    train: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = S.CATEGORICAL_FEATURES,
    *,
    scale: bool = False,
    fills: Fills | None = None,
) -> PipelineModel:
    """Fill (mode, median), one-hot (unknown levels become all zero) and, if asked, standardize.

    Only numbers are standardized, as columns of their own before the final vector. ``fills`` are those of the same rows, of these
    features and maybe others, if they are known.
    """
    cats = [f for f in features if f in categorical]
    nums = [f for f in features if f not in categorical]
    fills = fills or find_fills(train, features, categorical)
    modes, medians = fills.modes, fills.medians
    filled = [f"coalesce(CAST(`{c}` AS STRING), {_quoted(modes.get(c, S.MISSING_CATEGORY))}) AS `_c_{c}`" for c in cats]
    filled += [f"coalesce(CAST(`{n}` AS DOUBLE), {medians[n]!r}D) AS `_n_{n}`" for n in nums]
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    df = stages[0].transform(train)

    def add(stage) -> None:
        nonlocal df
        fitted = stage.fit(df) if hasattr(stage, "fit") else stage
        df = fitted.transform(df)
        stages.append(fitted)

    inputs = []
    if cats:
        indexed, encoded = [f"_i_{c}" for c in cats], [f"_o_{c}" for c in cats]
        add(
            StringIndexer(
                inputCols=[f"_c_{c}" for c in cats],
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        # The indexer gives unseen levels the last index, and that is the column dropped here.
        add(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        inputs += encoded
    if nums:
        add(VectorAssembler(inputCols=[f"_n_{n}" for n in nums], outputCol="_numbers"))
        if scale:
            add(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
        inputs.append("_scaled" if scale else "_numbers")
    add(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return PipelineModel(stages)


def fill_missing_categories(df: DataFrame, columns: Sequence[str] = S.CATEGORICAL_FEATURES) -> DataFrame:
    """Missing categories as a level of their own, for models that take categories as they are."""
    return df.fillna(S.MISSING_CATEGORY, subset=[c for c in columns if c in df.columns])


def with_class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: each class counts half, whatever its share."""
    row = train.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    total = row["n"] + row["p"]
    weight = F.when(F.col(label) == 1, total / (2.0 * max(row["p"], 1))).otherwise(total / (2.0 * max(row["n"], 1)))
    return train.withColumn(WEIGHT, weight)


# --------------------------------------------------------------------------- candidates
@dataclass(frozen=True)
class Candidate:
    """A model family: how to build it from a setting and the number of rows, and its search grid."""

    name: str
    build: Callable[[Mapping[str, Any], int], Any] | None
    grid: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    scale: bool = False


def candidates(label: str = "label", *, trees: int = 300, rounds: int = 100, seed: int = S.SEED) -> list[Candidate]:
    """Majority dummy, logistic regression, random forest and gradient boosting, class-balanced."""
    common = {"featuresCol": FEATURES, "labelCol": label, "weightCol": WEIGHT}

    def logistic(setting: Mapping[str, Any], rows: int):
        # C of the usual formulation is the inverse of the total penalty.
        penalty = 1.0 / (setting.get("C", 1.0) * max(rows, 1))
        return LogisticRegression(regParam=penalty, standardization=False, maxIter=100, tol=1e-4, **common)

    def forest(setting: Mapping[str, Any], rows: int):
        return RandomForestClassifier(
            numTrees=trees,
            maxDepth=setting.get("max_depth", 8),
            minInstancesPerNode=setting.get("min_leaf", 20),
            featureSubsetStrategy=setting.get("max_features", "sqrt"),
            cacheNodeIds=True,  # the same trees, but no row walks down every tree again for each level
            seed=seed,
            **common,
        )

    def boosting(setting: Mapping[str, Any], rows: int):
        return GBTClassifier(
            maxIter=rounds,
            stepSize=setting.get("learning_rate", 0.1),
            maxDepth=setting.get("max_depth", 4),
            subsamplingRate=setting.get("subsample", 1.0),
            seed=seed,
            **common,
        )

    # The search grids.
    return [
        Candidate(DUMMY_MODEL, None),
        Candidate("logistic", logistic, {"C": (0.03, 0.1, 0.3, 1.0, 3.0)}, scale=True),
        Candidate(
            "forest",
            forest,
            {"max_depth": (4, 6, 8, 12, UNLIMITED_DEPTH), "min_leaf": (20, 50, 100), "max_features": ("sqrt", "0.7", "all")},
        ),
        Candidate(
            "boosting",
            boosting,
            {"learning_rate": (0.03, 0.05, 0.1), "max_depth": (3, 4, 5), "subsample": (0.8, 1.0)},
        ),
    ]


def sample_settings(grid: Mapping[str, Sequence[Any]], limit: int = MAX_SETTINGS, seed: int = S.SEED) -> list[dict]:
    """At most ``limit`` different settings of the grid, drawn with a seed."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return every if len(every) <= limit else random.Random(seed).sample(every, limit)


def fit_estimator(candidate: Candidate, setting: Mapping[str, Any], prepared: DataFrame, label: str) -> Transformer:
    if candidate.build is None:
        row = prepared.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
        constant = 1.0 if 2 * row["p"] > row["n"] else 0.0
        return SQLTransformer(statement=f"SELECT *, CAST({constant} AS DOUBLE) AS {SCORE} FROM __THIS__")
    return candidate.build(setting, prepared.count()).fit(prepared)


def fit_candidate(
    candidate: Candidate,
    setting: Mapping[str, Any],
    train: DataFrame,
    features: Sequence[str],
    *,
    label: str = "label",
) -> PipelineModel:
    """Preprocessing and estimator fitted on the same rows, as one pipeline."""
    preprocessor = fit_preprocessor(train, features, scale=candidate.scale)
    prepared = prepare_rows(preprocessor, with_class_weight(train, label), label)
    try:
        return fit_prepared(candidate, setting, preprocessor, prepared, label=label)
    finally:
        prepared.unpersist()


def prepare_rows(preprocessor: PipelineModel, weighted: DataFrame, label: str = "label") -> DataFrame:
    """Label, weight and vector of every row, persisted."""
    return preprocessor.transform(weighted).select(label, WEIGHT, FEATURES).persist()


def fit_prepared(
    candidate: Candidate, setting: Mapping[str, Any], preprocessor: PipelineModel, prepared: DataFrame, *, label: str = "label"
) -> PipelineModel:
    """The estimator fitted on prepared rows, as one pipeline with what prepares them."""
    return PipelineModel([*preprocessor.stages, fit_estimator(candidate, setting, prepared, label)])


def score_rows(model: PipelineModel, df: DataFrame, score: str = SCORE) -> DataFrame:
    """Add the probability of an incident; helper columns of the pipeline are dropped."""
    out = model.transform(df)
    if "_calibrated" in out.columns:
        value = F.col("_calibrated").cast("double")
    elif "_calibrated_probability" in out.columns:
        value = vector_to_array("_calibrated_probability")[1]
    elif SCORE in out.columns and SCORE not in df.columns:
        value = F.col(SCORE)
    else:
        value = vector_to_array("probability")[1]
    kept = [F.col(c) for c in df.columns if c != score]
    return out.select(*kept, value.alias(score))


# --------------------------------------------------------------------------- search
def time_series_search(
    candidate: Candidate,
    train: DataFrame,
    features: Sequence[str],
    *,
    label: str = "label",
    issued: str = "issued_ts",
    tie_break: str = "row_no",
    folds: int = FOLDS,
    max_settings: int = MAX_SETTINGS,
    seed: int = S.SEED,
) -> DataFrame:
    """Mean average precision of each setting over expanding time folds, best first.

    A fold is prepared once for all settings, and all scores are judged in one pass.
    """
    settings = sample_settings(candidate.grid, max_settings, seed) if candidate.grid else [{}]
    folded = expanding_folds(train, folds, issued=issued, tie_break=tie_break)
    scored = None
    for k in range(1, folds + 1):
        earlier = folded.where(F.col("fold") < k)
        preprocessor = fit_preprocessor(earlier, features, scale=candidate.scale)
        prepared = preprocessor.transform(with_class_weight(earlier, label)).select(label, WEIGHT, FEATURES).persist()
        judged = preprocessor.transform(folded.where(F.col("fold") == k)).select(label, FEATURES)
        for i, setting in enumerate(settings):
            estimator = fit_estimator(candidate, setting, prepared, label)
            part = score_rows(PipelineModel([estimator]), judged).select(label, SCORE)
            part = part.withColumns({"setting": F.lit(i), "fold": F.lit(k)})
            scored = part if scored is None else scored.unionByName(part)
        prepared.unpersist()
    report = ranking_report(materialize(scored, "search-scores"), label=label, within=["setting", "fold"])
    names = train.sparkSession.createDataFrame(
        [(i, repr(sorted(s.items()))) for i, s in enumerate(settings)], "setting int, parameters string"
    )
    means = report.groupBy("setting").agg(F.avg("pr_auc").alias("mean_pr_auc"), F.count("pr_auc").alias("folds"))
    return means.join(F.broadcast(names), "setting").orderBy(F.desc("mean_pr_auc"), "setting")


def best_setting(candidate: Candidate, search: DataFrame, max_settings: int = MAX_SETTINGS, seed: int = S.SEED) -> dict:
    settings = sample_settings(candidate.grid, max_settings, seed) if candidate.grid else [{}]
    return settings[search.first()["setting"]]


# --------------------------------------------------------------------------- experiments
@dataclass
class Trained:
    experiment: str
    model: str
    pipeline: PipelineModel
    features: tuple[str, ...]
    setting: dict


def train_experiments(
    train: DataFrame,
    validation: DataFrame,
    experiments: Mapping[str, Sequence[str]],
    models: Sequence[Candidate],
    *,
    label: str = "label",
    search: bool = True,
    max_settings: int = MAX_SETTINGS,
    left_out: list[tuple[str, str, str]] | None = None,
) -> tuple[list[Trained], DataFrame]:
    """Fit every model on every feature set and judge all of them on the validation rows.

    Each model scores each validation row once; the scores are written and judged from there. A model that
    cannot be built or is refused is left out, and noted as (experiment, model, reason) in ``left_out``; any other error ends the job.
    """
    trained: list[Trained] = []
    left_out = [] if left_out is None else left_out
    for experiment, features in experiments.items():
        for candidate in models:
            try:
                setting: dict = {}
                if search and candidate.grid:
                    table = time_series_search(candidate, train, features, label=label, max_settings=max_settings)
                    setting = best_setting(candidate, table, max_settings)
                pipeline = fit_candidate(candidate, setting, train, features, label=label)
            except UNUSABLE as refused:
                log.warning("model %s left out of experiment %s: %s", candidate.name, experiment, refused)
                left_out.append((experiment, candidate.name, str(refused)))
                continue
            trained.append(Trained(experiment, candidate.name, pipeline, tuple(features), setting))
    return trained, compare_trained(trained, validation, label=label)


def compare_trained(trained: Sequence[Trained], validation: DataFrame, *, label: str = "label") -> DataFrame:
    """All models judged on the validation rows; each scores each row once."""
    scored = None
    for t in trained:
        part = score_rows(t.pipeline, validation).select(label, SCORE)
        part = part.withColumns({"experiment": F.lit(t.experiment), "model": F.lit(t.model)})
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise RuntimeError("no candidate model could be trained")
    return model_table(materialize(scored, "comparison-scores"), label=label)


def pick_best(trained: Sequence[Trained], models: DataFrame) -> tuple[Trained, float]:
    """The best trained model and its threshold."""
    row = select_best(models).first()
    if row is None:
        raise RuntimeError("only the dummy was trained")
    best = next(t for t in trained if (t.experiment, t.model) == (row["experiment"], row["model"]))
    return best, row["threshold"]


# --------------------------------------------------------------------------- calibration
def calibrate(pipeline: PipelineModel, validation: DataFrame, *, label: str = "label") -> tuple[PipelineModel, DataFrame]:
    """Sigmoid and isotonic calibration; kept only if Brier improves at 97 % of the average precision.

    As agreed, calibration is fitted and judged on the same rows, which is optimistic.
    Returns the pipeline to use and one row per method with ``selected``.
    """
    slicer = VectorSlicer(inputCol="probability", outputCol="_raw_score", indices=[1])
    points = (
        pipeline.transform(validation)
        .groupBy(F.col(label).cast("double").alias(label), vector_to_array("probability")[1].alias("_point"))
        .agg(F.count(F.lit(1)).cast("double").alias("_rows"))
    )
    assembler = VectorAssembler(inputCols=["_point"], outputCol="_raw_score")
    raw = assembler.transform(points).select(label, "_raw_score", "_rows").persist()
    sigmoid = LogisticRegression(
        featuresCol="_raw_score",
        labelCol=label,
        weightCol="_rows",
        predictionCol="_calibrated_label",
        rawPredictionCol="_calibrated_raw",
        probabilityCol="_calibrated_probability",
    )
    isotonic = IsotonicRegression(featuresCol="_raw_score", labelCol=label, weightCol="_rows", predictionCol="_calibrated")
    pipelines = {"original": pipeline}
    for method, estimator in (("sigmoid", sigmoid), ("isotonic", isotonic)):
        pipelines[method] = PipelineModel([*pipeline.stages, slicer, estimator.fit(raw)])
    raw.unpersist()
    scored = None
    for method, p in pipelines.items():
        part = score_rows(p, validation).select(label, SCORE, F.lit(method).alias("method"))
        scored = part if scored is None else scored.unionByName(part)
    scored = materialize(scored, "calibration-scores")
    report = ranking_report(scored, label=label, within=["method"]).join(
        brier(scored, label=label, within=["method"]), "method"
    )
    rows = {r["method"]: r for r in report.collect()}  # three rows
    chosen, best_brier = "original", rows["original"]["brier"]
    for method in ("sigmoid", "isotonic"):
        keeps_ranking = rows[method]["pr_auc"] >= rows["original"]["pr_auc"] * MIN_KEPT_PR_AUC
        if rows[method]["brier"] < best_brier and keeps_ranking:
            chosen, best_brier = method, rows[method]["brier"]
    table = validation.sparkSession.createDataFrame(
        [(m, r["brier"], r["pr_auc"], m == chosen) for m, r in rows.items()],
        "method string, brier double, pr_auc double, selected boolean",
    )
    return pipelines[chosen], table


def choose_threshold(pipeline: PipelineModel, validation: DataFrame, *, label: str = "label") -> float:
    return select_threshold(threshold_sweep(score_rows(pipeline, validation), label=label)).first()["threshold"]


# --------------------------------------------------------------------------- final evaluation
def final_evaluate(scored: DataFrame, threshold: float, *, label: str = "label", rounds: int = S.BOOTSTRAP_ROUNDS) -> DataFrame:
    """Test metrics as (metric, value, low, high); bounds where a bootstrap interval exists."""
    wide = confusion_metrics(scored, threshold, label=label)
    names = [c for c in wide.columns]
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    tall = wide.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")
    ranking = ranking_report(scored, label=label)
    tall = tall.unionByName(
        ranking.selectExpr("stack(2, 'pr_auc', pr_auc, 'roc_auc', roc_auc) AS (metric, value)")
    ).unionByName(brier(scored, label=label).selectExpr("'brier' AS metric", "brier AS value"))
    bounds = bootstrap_ci(scored, threshold, label=label, rounds=rounds).drop("rounds")
    return tall.join(F.broadcast(bounds), "metric", "left")  # four rows


def feature_pieces(prepare: PipelineModel, features: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Where each feature is in the prepared vector: start and width. Levels come first, then numbers, both in the given order."""
    levels: dict[str, int] = {}
    for stage in prepare.stages:
        if isinstance(stage, StringIndexerModel):
            names = [c.removeprefix("_c_") for c in stage.getInputCols()]
            levels = {c: len(known) for c, known in zip(names, stage.labelsArray, strict=True)}
    pieces, start = {}, 0
    for f in [*[f for f in features if f in levels], *[f for f in features if f not in levels]]:
        pieces[f] = (start, levels.get(f, 1))
        start += levels.get(f, 1)
    return pieces


def permutation_importance(
    pipeline: PipelineModel,
    test: DataFrame,
    features: Sequence[str],
    *,
    label: str = "label",
    repeats: int = 5,
    order: str = "row_no",
    seed: int = S.SEED,
) -> DataFrame:
    """Mean loss of average precision when one feature is permuted, most important first.

    Rows are prepared once; a permuted copy swaps one piece of the prepared vector. Every copy is scored once.
    """
    at = next(i for i, stage in enumerate(pipeline.stages) if stage.hasParam("outputCol") and stage.getOutputCol() == FEATURES)
    prepare, model = PipelineModel(pipeline.stages[: at + 1]), PipelineModel(pipeline.stages[at + 1 :])
    rows = prepare.transform(test.select(label, order, *features))
    rows = materialize(rows.select(label, order, vector_to_array(FEATURES).alias("_x")), "importance-rows")

    def scored(df: DataFrame) -> DataFrame:
        return score_rows(model, df.withColumn(FEATURES, array_to_vector("_x")).drop("_x"))

    base = ranking_report(scored(rows), label=label).first()["pr_auc"]
    permuted = permuted_pieces(rows, "_x", feature_pieces(prepare, features), repeats=repeats, order=order, seed=seed)
    report = ranking_report(scored(permuted), label=label, within=["feature", "repeat"])
    drop = F.lit(base) - F.col("pr_auc")
    table = report.groupBy("feature").agg(
        F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("spread"), F.count("pr_auc").alias("repeats")
    )
    return table.orderBy(F.desc("importance"), "feature")


# --------------------------------------------------------------------------- bundle
@dataclass
class Bundle:
    pipeline: PipelineModel
    features: tuple[str, ...]
    threshold: float
    cuts: tuple[float, float]
    experiment: str = ""
    model: str = ""


_BUNDLE_SCHEMA = (
    "features array<string>, threshold double, low_medium double, medium_high double, experiment string, model string"
)


_POINTER_SCHEMA = "version bigint, folder string"


def _published(spark: SparkSession, path: str) -> Row | None:
    """The newest version that was announced."""
    if not exists(spark, f"{path}/published"):
        return None
    return spark.read.parquet(f"{path}/published").orderBy(F.desc("version"), F.desc("folder")).first()


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> int:
    """Write the pipeline, and a one-row table with all that scoring needs besides it, as a new version; its number.

    Both go to a folder of their own. The pointer to it is written last, so a reader finds the old version or the new one, never a
    mixture, and a broken write is never found.
    """
    last = _published(spark, path)
    version = 0 if last is None else last["version"] + 1
    folder = f"versions/{version}-{uuid.uuid4().hex}"
    bundle.pipeline.write().save(f"{path}/{folder}/pipeline")
    row = (list(bundle.features), bundle.threshold, *bundle.cuts, bundle.experiment, bundle.model)
    spark.createDataFrame([row], _BUNDLE_SCHEMA).write.parquet(f"{path}/{folder}/settings")
    spark.createDataFrame([(version, folder)], _POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The newest complete version."""
    last = _published(spark, path)
    if last is None:
        raise ValueError("model bundle: nothing published")
    path = f"{path}/{last['folder']}"
    settings = spark.read.parquet(f"{path}/settings")
    S.require_columns(settings, ("features", "threshold", "low_medium", "medium_high"), "model bundle")
    row = settings.first()
    if row is None or not row["features"]:
        raise ValueError("model bundle: no features")
    return Bundle(
        PipelineModel.load(f"{path}/pipeline"),
        tuple(row["features"]),
        row["threshold"],
        (row["low_medium"], row["medium_high"]),
        row["experiment"],
        row["model"],
    )
