"""Queries over splits, metrics, thresholds and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import correlate, enrich, evaluate, resample, split
from ledgerscope.operators.ranks import exact_quantiles
from ledgerscope.plans import fixtures as fx
from ledgerscope.plans.registry import query

DIGITS = 10


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# --------------------------------------------------------------------------- splits
_SPLIT_SQL = """
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY issued_ts, row_no) - 1 AS rk, count(*) OVER () AS n
  FROM scores WHERE issued_ts IS NOT NULL),
parted AS (SELECT *, CASE WHEN rk >= CAST(floor(n * 0.8) AS BIGINT) THEN 'test'
  WHEN rk >= CAST(floor(CAST(floor(n * 0.8) AS BIGINT) * 0.8) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
  FROM ranked)
"""


@query("temporal_split", _SPLIT_SQL + "SELECT row_no, issued_ts, label, split FROM parted", ("scores",))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.temporal_split(fx.scores(spark, sf_dir)).select("row_no", "issued_ts", "label", "split")


@query("temporal_split_large", _SPLIT_SQL + "SELECT row_no, issued_ts, label, split FROM parted", ("scores",))
def temporal_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split with borders found by histogram passes, as for tables too long for a window."""
    parts = split.temporal_split(fx.scores(spark, sf_dir), small_rows=0)
    return parts.select("row_no", "issued_ts", "label", "split")


@query(
    "split_summary",
    _SPLIT_SQL
    + """SELECT split, count(*) AS rows, CAST(min(issued_ts) AS DATE) AS first_day, CAST(max(issued_ts) AS DATE) AS last_day,
  count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives
FROM parted GROUP BY split""",
    ("scores",),
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_summary(split.temporal_split(fx.scores(spark, sf_dir)))


@query(
    "expanding_folds",
    """
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY issued_ts, row_no) - 1 AS rk, count(*) OVER () AS n
  FROM scores WHERE issued_ts IS NOT NULL)
SELECT row_no, CAST(CASE WHEN rk >= n - (n // 4) THEN 3 WHEN rk >= n - 2 * (n // 4) THEN 2
  WHEN rk >= n - 3 * (n // 4) THEN 1 ELSE 0 END AS INTEGER) AS fold FROM ranked""",
    ("scores",),
)
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.expanding_folds(split.usable_rows(fx.scores(spark, sf_dir))).select("row_no", "fold")


@query(
    "class_balance",
    """SELECT count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives,
  CAST(greatest(count(*) FILTER (WHERE label = 0), 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE label = 1), 1) AS ratio
FROM scores""",
    ("scores",),
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.class_balance(fx.scores(spark, sf_dir))


# --------------------------------------------------------------------------- metrics
def _metric_columns(group: str = "") -> str:
    return f"""{group}
  tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
  round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 10) AS accuracy,
  round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 10) AS balanced_accuracy,
  round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 10) AS precision,
  round(tp / CAST(tp + fn AS DOUBLE), 10) AS recall,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 10) AS f1,
  round(tn / CAST(tn + fp AS DOUBLE), 10) AS specificity,
  round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
    / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 10) AS mcc,
  round(100 * ((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE)), 10) AS flagged_pct"""


def _cells(threshold: str) -> str:
    return f"""count(*) FILTER (WHERE label = 0 AND score < {threshold}) AS tn,
  count(*) FILTER (WHERE label = 0 AND score >= {threshold}) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < {threshold}) AS fn,
  count(*) FILTER (WHERE label = 1 AND score >= {threshold}) AS tp"""


@query(
    "confusion_metrics",
    f"SELECT {_metric_columns()} FROM (SELECT {_cells('0.5')} FROM scores)",
    ("scores",),
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.confusion_metrics(fx.scores(spark, sf_dir), 0.5))


_CUMULATIVE = """
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
  SELECT experiment, model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM model_scores GROUP BY ALL) WINDOW w AS (PARTITION BY experiment, model ORDER BY score DESC)),
ranking AS (SELECT experiment, model, sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) AS pr_auc,
  CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
  FROM cum GROUP BY experiment, model)
"""


@query(
    "average_precision",
    f"WITH {_CUMULATIVE.strip()} SELECT experiment, model, round(pr_auc, 10) AS pr_auc FROM ranking",
    ("model_scores",),
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.ranking_report(fx.model_scores(spark, sf_dir), within=["experiment", "model"])
    return _rounded(report.drop("roc_auc"))


@query(
    "roc_auc",
    """
WITH ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid
  FROM scores)
SELECT round((sum(mid) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * CAST(n AS DOUBLE)), 10) AS roc_auc
FROM ranked, (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM scores)
GROUP BY p, n""",
    ("scores",),
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.ranking_report(fx.scores(spark, sf_dir)).drop("pr_auc"))


@query(
    "pr_curve",
    """
WITH g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM scores GROUP BY score),
c AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))
SELECT score, tp, fp, round(tp / CAST(tp + fp AS DOUBLE), 10) AS precision, round(tp / CAST(p AS DOUBLE), 10) AS recall,
  round(fp / CAST(n AS DOUBLE), 10) AS false_positive_rate FROM c""",
    ("scores",),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.curve_points(fx.scores(spark, sf_dir)))


@query(
    "calibration_bins",
    f"""
WITH e AS (SELECT {", ".join(f"quantile_cont(score, 0.{i}) AS e{i}" for i in range(1, 10))} FROM scores)
SELECT CAST({" + ".join(f"CAST(score > e{i} AS INTEGER)" for i in range(1, 10))} AS INTEGER) AS bin,
  round(avg(score), 10) AS mean_score, round(avg(CAST(label AS DOUBLE)), 10) AS positive_share, count(*) AS n
FROM scores, e GROUP BY 1""",
    ("scores",),
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.calibration_bins(fx.scores(spark, sf_dir)))


@query("brier", "SELECT round(avg((score - label) * (score - label)), 10) AS brier FROM scores", ("scores",))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.brier(fx.scores(spark, sf_dir)))


# --------------------------------------------------------------------------- thresholds and choices
_SWEEP = f"""
cells AS (SELECT experiment, model, t.threshold, {_cells("t.threshold")}
  FROM model_scores, (SELECT CAST(unnest(range(5, 96)) AS DOUBLE) / 100.0 AS threshold) t GROUP BY ALL),
sweep AS (SELECT {_metric_columns("experiment, model, threshold,")} FROM cells),
picked AS (SELECT *, recall >= 0.6 AS recall_reached, row_number() OVER (PARTITION BY experiment, model
  ORDER BY recall >= 0.6 DESC, f1 DESC, CASE WHEN recall >= 0.6 THEN precision ELSE 0 END DESC, threshold) AS rn
  FROM sweep),
models AS (SELECT p.*, r.pr_auc, r.roc_auc, b.brier FROM picked p
  JOIN ranking r ON p.experiment = r.experiment AND p.model = r.model
  JOIN (SELECT experiment, model, avg((score - label) * (score - label)) AS brier FROM model_scores GROUP BY ALL) b
    ON p.experiment = b.experiment AND p.model = b.model WHERE rn = 1)
"""
_SWEEP_SQL = f"WITH {_CUMULATIVE.strip()}, {_SWEEP.strip()}\n"


@query(
    "threshold_sweep",
    _SWEEP_SQL
    + """SELECT experiment, model, threshold, precision, recall, f1, balanced_accuracy, false_positives, false_negatives,
  flagged_pct FROM sweep""",
    ("model_scores",),
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.threshold_sweep(fx.model_scores(spark, sf_dir), within=["experiment", "model"]))


@query(
    "selected_threshold",
    _SWEEP_SQL + "SELECT experiment, model, threshold, recall_reached, f1, precision, recall FROM picked WHERE rn = 1",
    ("model_scores",),
)
def selected_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = ["experiment", "model"]
    sweep = evaluate.threshold_sweep(fx.model_scores(spark, sf_dir), within=group)
    return _rounded(evaluate.select_threshold(sweep, within=group))


_MODEL_COLUMNS = (
    "experiment, model, threshold, true_negatives, false_positives, false_negatives, true_positives, accuracy, "
    "balanced_accuracy, precision, recall, f1, specificity, mcc, flagged_pct, round(pr_auc, 10) AS pr_auc, "
    "round(roc_auc, 10) AS roc_auc, round(brier, 10) AS brier"
)


@query("model_table", _SWEEP_SQL + f"SELECT {_MODEL_COLUMNS} FROM models", ("model_scores",))
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.model_table(fx.model_scores(spark, sf_dir)))


@query(
    "best_model",
    _SWEEP_SQL
    + f"""SELECT {_MODEL_COLUMNS} FROM models WHERE model <> 'dummy'
ORDER BY models.pr_auc DESC, f1 DESC, recall DESC, experiment, model LIMIT 1""",
    ("model_scores",),
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.select_best(evaluate.model_table(fx.model_scores(spark, sf_dir))))


def _delta_columns() -> str:
    columns = []
    for m in evaluate.COMPARED:
        shown = (lambda x: x) if m.startswith("false_") else (lambda x: f"round({x}, 6)")
        columns += [
            f"{shown(f'b.{m}')} AS {m}_base",
            f"{shown(f'e.{m}')} AS {m}_extended",
            f"{shown(f'e.{m} - b.{m}')} AS {m}_delta",
            f"round((e.{m} - b.{m}) * 100.0 / nullif(abs(b.{m}), 0), 3) AS {m}_delta_pct",
        ]
    return ", ".join(columns)


@query(
    "experiment_delta",
    _SWEEP_SQL
    + f"""SELECT b.model, {_delta_columns()},
  CASE WHEN e.pr_auc - b.pr_auc > 0.005 AND e.f1 - b.f1 > 0 THEN 'aporta' ELSE 'aporte_minimo_o_negativo' END AS verdict
FROM models b JOIN models e ON b.model = e.model WHERE b.experiment = 'base' AND e.experiment = 'extended'""",
    ("model_scores",),
)
def experiment_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = evaluate.model_table(fx.model_scores(spark, sf_dir))
    delta = evaluate.experiment_delta(models, "base", "extended")
    percents = [c for c in delta.columns if c.endswith("_pct")]
    plain = [c for c, t in delta.dtypes if t == "double" and c not in percents]
    return delta.withColumns({c: F.round(c, 6) for c in plain} | {c: F.round(c, 3) for c in percents})


@query(
    "reliability",
    _SWEEP_SQL
    + """SELECT m.experiment, m.model, CASE WHEN m.pr_auc <= d.pr_auc * 1.05 OR m.f1 < 0.12 THEN 'No confiable'
  WHEN m.f1 < 0.30 OR m.precision < 0.20 THEN 'Limitada' WHEN m.f1 < 0.50 THEN 'Aceptable para priorizacion'
  ELSE 'Buena' END AS reliability
FROM models m JOIN models d ON m.experiment = d.experiment AND d.model = 'dummy' WHERE m.model <> 'dummy'""",
    ("model_scores",),
)
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = evaluate.model_table(fx.model_scores(spark, sf_dir))
    dummy = models.where(F.col("model") == evaluate.DUMMY_MODEL).select("experiment", F.col("pr_auc").alias("dummy_pr_auc"))
    joined = models.where(F.col("model") != evaluate.DUMMY_MODEL).join(F.broadcast(dummy), "experiment")
    level = evaluate.reliability(F.col("pr_auc"), F.col("f1"), F.col("precision"), F.col("dummy_pr_auc"))
    return joined.select("experiment", "model", level.alias("reliability"))


@query(
    "risk_cuts",
    """SELECT round(quantile_cont(probability, 0.33), 9) AS low_medium, round(quantile_cont(probability, 0.85), 9) AS medium_high
FROM predictions""",
    ("predictions",),
)
def risk_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerscope.plans.pipeline import risk_cut_table

    return _rounded(risk_cut_table(fx.predictions(spark, sf_dir)), 9)


@query(
    "exact_quantiles_large",
    f"""SELECT {", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{int(q * 100)}" for q in (0.05, 0.33, 0.5, 0.85))}
FROM lineitem""",
)
def exact_quantiles_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles by histogram passes, as for columns too long for one aggregate."""
    shares = (0.05, 0.33, 0.5, 0.85)
    lines = fx.table(spark, sf_dir, "lineitem")
    found = exact_quantiles(lines, "l_extendedprice", shares, small_rows=0, bins=64)
    schema = ", ".join(f"q{int(q * 100)} double" for q in shares)
    return _rounded(spark.createDataFrame([tuple(found)], schema), 6)


# --------------------------------------------------------------------------- correlation
_NUMBERS = (
    "amount", "log_amount", "issue_month", "issue_year", "issue_quarter", "issue_weekday", "term_days", "irregular",
    "registry_found", "is_withholding", "is_good_taxpayer", "is_fuel_perception", "is_domestic_perception",
)
_CATEGORIES = ("doc_type", "currency", "key_status", "domicile")


@query(
    "target_correlation",
    """WITH known AS (SELECT * FROM derived WHERE incident IS NOT NULL), r AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, incident) AS c FROM known" for c in _NUMBERS)
    + "".join(
        f""" UNION ALL SELECT '{c}_' || coalesce(lvl, 'nan'), corr(CAST({c} IS NOT DISTINCT FROM lvl AS INTEGER), incident)
  FROM known, (SELECT DISTINCT {c} AS lvl FROM known) GROUP BY lvl"""
        for c in _CATEGORIES
    )
    + """) SELECT variable, round(c, 8) AS correlation, round(abs(c), 8) AS strength FROM r
WHERE c IS NOT NULL AND NOT isnan(c)""",
    ("derived",),
)
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.derive_columns(fx.enriched(spark, sf_dir))
    table = correlate.target_correlations(rows, _NUMBERS, _CATEGORIES)
    return _rounded(table.select("variable", "correlation", "strength"), 8)


def _variables_sql() -> str:
    """Long form: one row per known invoice and variable, categories as 0/1 per level."""
    parts = [f"SELECT row_no, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM known" for c in ("incident", *_NUMBERS)]
    for c in _CATEGORIES:
        parts.append(
            f"SELECT row_no, '{c}_' || coalesce(lvl, 'nan'), CAST({c} IS NOT DISTINCT FROM lvl AS DOUBLE) "
            f"FROM known, (SELECT DISTINCT {c} AS lvl FROM known)"
        )
    return " UNION ALL ".join(parts)


@query(
    "correlation_matrix",
    f"""
WITH known AS (SELECT * FROM derived WHERE incident IS NOT NULL),
long AS ({_variables_sql()}),
strength AS (SELECT a.variable, abs(corr(a.v, b.v)) AS s FROM long a JOIN long b ON a.row_no = b.row_no
  WHERE b.variable = 'incident' AND a.variable <> 'incident' GROUP BY a.variable),
chosen AS (SELECT * FROM long WHERE variable = 'incident' OR variable IN (
  SELECT variable FROM strength WHERE s IS NOT NULL AND NOT isnan(s) ORDER BY round(s, 10) DESC, variable LIMIT 20))
SELECT a.variable AS variable_a, b.variable AS variable_b, round(corr(a.v, b.v), 8) AS correlation
FROM chosen a JOIN chosen b ON a.row_no = b.row_no AND a.variable < b.variable GROUP BY ALL""",
    ("derived",),
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.derive_columns(fx.enriched(spark, sf_dir))
    return _rounded(correlate.correlation_matrix(rows, _NUMBERS, _CATEGORIES), 8)


# --------------------------------------------------------------------------- resampling
def _poisson_sql(powers: int = 15) -> str:
    tables = [resample.poisson_table(k) for k in range(powers)]
    rows = ", ".join(f"({k}, {first}, [{', '.join(f'{p}::BIGINT' for p in places)}])" for k, (first, places) in enumerate(tables))
    return f"(VALUES {rows}) AS t(k, first, places)"


_BOOTSTRAP_SQL = f"""
WITH g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scores GROUP BY score),
c AS (SELECT score, 'pos' AS side, pos AS n FROM g UNION ALL SELECT score, 'neg', neg FROM g),
draws AS (SELECT score, side, r, t.first + len(list_filter(places, lambda p: p <=
    ('0x' || substr(md5(concat_ws(':', CAST(floor(score * 4503599627370496) AS BIGINT), r, {S.SEED}, side, t.k)), 1, 13))::BIGINT)) AS w
  FROM c, range(1, {S.BOOTSTRAP_ROUNDS} + 1) AS rounds(r), {_poisson_sql()} WHERE (n >> t.k) & 1 = 1),
drawn AS (SELECT score, r, coalesce(sum(w) FILTER (WHERE side = 'pos'), 0) AS pos, coalesce(sum(w) FILTER (WHERE side = 'neg'), 0) AS neg
  FROM draws GROUP BY score, r),
run AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM drawn WINDOW o AS (PARTITION BY r ORDER BY score DESC)),
m AS (SELECT r, sum(pos) AS p, sum(neg) AS n, coalesce(sum(pos) FILTER (WHERE score >= 0.3), 0)::DOUBLE AS tp,
  coalesce(sum(neg) FILTER (WHERE score >= 0.3), 0)::DOUBLE AS fp,
  sum(CASE WHEN tp + fp > 0 THEN pos * tp::DOUBLE / (tp + fp) ELSE 0 END) / sum(pos) AS ap FROM run GROUP BY r),
v AS (SELECT coalesce(tp / nullif(p, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(2 * tp / nullif(tp + fp + p, 0), 0) AS f1, ap AS pr_auc FROM m WHERE p > 0 AND n > 0),
long AS (UNPIVOT v ON recall, precision, f1, pr_auc INTO NAME metric VALUE value)
SELECT metric, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS rounds
FROM long GROUP BY metric"""


@query("bootstrap_ci", _BOOTSTRAP_SQL, ("scores",))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = resample.bootstrap_ci(fx.scores(spark, sf_dir), 0.3)
    return bounds.withColumns({c: F.round(c, 9) for c in ("low", "high")})
