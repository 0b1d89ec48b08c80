"""Queries over scored pending invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.risk import prediction_code, prediction_label, risk_tier
from ledgerscope.functions.text import ellipsize, mask, month_label
from ledgerscope.operators import dashboard
from ledgerscope.plans import fixtures as fx
from ledgerscope.plans.registry import query

_NAME = "coalesce(nullif(trim(supplier_name), ''), nullif(trim(legal_name), ''), '')"


@query("risk_tiers", "SELECT row_no, probability, tier, code, label FROM predictions", ("predictions",))
def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = prediction_code(F.col("probability"), fx.FIXED_THRESHOLD)
    return fx.predictions(spark, sf_dir).select(
        "row_no",
        "probability",
        risk_tier(F.col("probability"), *fx.FIXED_CUTS).alias("tier"),
        code.alias("code"),
        prediction_label(code).alias("label"),
    )


@query("risk_reasons", "SELECT row_no, key_status, domicile, reasons FROM predictions", ("predictions",))
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.predictions(spark, sf_dir).select("row_no", "key_status", "domicile", "reasons")


@query("best_names", f"SELECT row_no, {_NAME} AS name FROM predictions", ("predictions",))
def best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = fx.predictions(spark, sf_dir)
    return pred.select("row_no", dashboard.supplier_name(pred).alias("name"))


@query("has_names", f"SELECT bool_or({_NAME} <> '') AS has_names FROM predictions", ("predictions",))
def has_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.has_names(fx.predictions(spark, sf_dir))


@query(
    "masked_names",
    f"""SELECT row_no, CASE WHEN name <> '' THEN '***' ELSE name END AS masked_name,
  CASE WHEN length(address) > 12 THEN left(address, 11) || '…' ELSE address END AS short_address
FROM (SELECT row_no, {_NAME} AS name, address FROM predictions)""",
    ("predictions",),
)
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = fx.predictions(spark, sf_dir)
    return pred.select(
        "row_no",
        mask(dashboard.supplier_name(pred)).alias("masked_name"),
        ellipsize(F.col("address"), 12).alias("short_address"),
    )


@query(
    "kpis",
    """SELECT count(*) AS pending, count(*) FILTER (WHERE tier = 'Alto') AS high_risk,
  round(100.0 * CAST(count(*) FILTER (WHERE tier = 'Alto') AS DOUBLE) / count(*), 10) AS high_risk_pct,
  count(*) FILTER (WHERE code = 1) AS flagged,
  round(100.0 * CAST(count(*) FILTER (WHERE code = 1) AS DOUBLE) / count(*), 10) AS flagged_pct,
  round(avg(probability), 10) AS mean_probability FROM predictions""",
    ("predictions",),
)
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = dashboard.kpis(fx.predictions(spark, sf_dir))
    return row.withColumns({c: F.round(c, 10) for c in ("high_risk_pct", "flagged_pct", "mean_probability")})


@query(
    "tier_counts",
    """SELECT tier_order, d.tier, count(p.tier) AS n,
  round(CAST(count(p.tier) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM predictions), 10) AS share,
  round(coalesce(avg(probability), 0.0), 10) AS mean_probability
FROM (SELECT unnest([0, 1, 2]) AS tier_order, unnest(['Bajo', 'Medio', 'Alto']) AS tier) d
LEFT JOIN predictions p ON d.tier = p.tier GROUP BY tier_order, d.tier""",
    ("predictions",),
)
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dashboard.tier_counts(fx.predictions(spark, sf_dir))
    return table.withColumns({c: F.round(c, 10) for c in ("share", "mean_probability")})


_MONTHLY = """
WITH monthly AS (SELECT CAST(date_trunc('month', issued_ts) AS DATE) AS month, avg(probability) AS p,
  count(*) FILTER (WHERE tier = 'Alto') AS high_risk, count(*) AS n
  FROM predictions WHERE issued_ts IS NOT NULL GROUP BY 1)
"""


@query(
    "risk_by_month",
    _MONTHLY + "SELECT month, round(p, 10) AS mean_probability, high_risk, n FROM monthly",
    ("predictions",),
)
def risk_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.risk_by_month(fx.predictions(spark, sf_dir)).withColumn(
        "mean_probability", F.round("mean_probability", 10)
    )


@query(
    "monthly_smooth",
    _MONTHLY
    + """SELECT month, round(p, 10) AS mean_probability, high_risk, n,
  round(avg(p) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 10) AS smoothed,
  row_number() OVER (ORDER BY round(p, 10) DESC, month) = 1 AS is_peak FROM monthly""",
    ("predictions",),
)
def monthly_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = dashboard.monthly_smooth(dashboard.risk_by_month(fx.predictions(spark, sf_dir)))
    return smooth.withColumns({c: F.round(c, 10) for c in ("mean_probability", "smoothed")})


@query(
    "risk_heatmap",
    """
WITH rows_ AS (SELECT doc_type, CAST(date_trunc('month', issued_ts) AS DATE) AS month, probability FROM predictions
  WHERE issued_ts IS NOT NULL),
cells AS (SELECT doc_type, month, avg(probability) AS p, count(*) AS n FROM rows_
  WHERE month IN (SELECT DISTINCT month FROM rows_ ORDER BY month DESC LIMIT 12) GROUP BY doc_type, month)
SELECT doc_type, month, ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Set','Oct','Nov','Dic'][month(month)]
    || ' ' || lpad(CAST(year(month) % 100 AS VARCHAR), 2, '0') AS month_label,
  round(p, 10) AS mean_probability, n, round(avg(p) OVER (PARTITION BY doc_type), 10) AS row_mean FROM cells""",
    ("predictions",),
)
def risk_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dashboard.risk_heatmap(fx.predictions(spark, sf_dir))
    return cells.withColumns({c: F.round(c, 10) for c in ("mean_probability", "row_mean")})


@query(
    "risk_heatmap_wide",
    """
WITH rows_ AS (SELECT doc_type, CAST(date_trunc('month', issued_ts) AS DATE) AS month, probability FROM predictions
  WHERE issued_ts IS NOT NULL),
placed AS (SELECT *, dense_rank() OVER (ORDER BY month) AS k FROM rows_
  WHERE month IN (SELECT DISTINCT month FROM rows_ ORDER BY month DESC LIMIT 12)),
cells AS (SELECT doc_type, k, round(avg(probability), 10) AS p FROM placed GROUP BY doc_type, k)
SELECT doc_type, (SELECT ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Set','Oct','Nov','Dic'][month(min(month))]
  || ' ' || lpad(CAST(year(min(month)) % 100 AS VARCHAR), 2, '0') FROM placed) AS first_month,
  """
    + ", ".join(f"max(p) FILTER (WHERE k = {i}) AS m{i}" for i in range(1, 13))
    + """
FROM cells GROUP BY doc_type""",
    ("predictions",),
)
def risk_heatmap_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the months under names that do not depend on the data."""
    wide = dashboard.risk_heatmap_wide(fx.predictions(spark, sf_dir))
    months = wide.columns[1:]
    cells = [F.round(F.col(f"`{months[i]}`"), 10) if i < len(months) else F.lit(None).cast("double") for i in range(12)]
    first = F.lit(months[0] if months else None).cast("string").alias("first_month")
    return wide.select("doc_type", first, *[c.alias(f"m{i}") for i, c in enumerate(cells, 1)])


@query(
    "month_labels",
    """SELECT row_no, ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Set','Oct','Nov','Dic'][month(issued_ts)]
  || ' ' || lpad(CAST(year(issued_ts) % 100 AS VARCHAR), 2, '0') AS month_label FROM invoices""",
    ("invoices",),
)
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.invoices(spark, sf_dir).select("row_no", month_label(F.col("issued_ts")).alias("month_label"))


@query(
    "top_risk_factors",
    """
SELECT factor, count(*) AS n FROM (
  SELECT regexp_replace(trim(f), '^(Estado RUC|Domicilio) .+$', '\\1 irregular') AS factor
  FROM (SELECT unnest(string_split(reasons, ';')) AS f FROM predictions WHERE tier = 'Alto')
  WHERE trim(f) NOT IN ('', 'Sin factores de riesgo destacados'))
GROUP BY factor ORDER BY n DESC, factor LIMIT 6""",
    ("predictions",),
)
def top_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.top_risk_factors(fx.predictions(spark, sf_dir))


@query(
    "top_risk_entities",
    f"""
SELECT supplier_key, count(*) AS high_risk, round(avg(probability), 10) AS mean_probability,
  CAST(sum(TRY_CAST(amount AS DECIMAL(38, 6))) AS DOUBLE) AS amount, arg_min({_NAME}, row_no) AS name
FROM predictions WHERE tier = 'Alto' AND supplier_key IS NOT NULL GROUP BY supplier_key
ORDER BY high_risk DESC, avg(probability) DESC, supplier_key LIMIT 10""",
    ("predictions",),
)
def top_risk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.top_risk_suppliers(fx.predictions(spark, sf_dir)).withColumn(
        "mean_probability", F.round("mean_probability", 10)
    )


_LABELS = dict(zip(S.LIST_FLAGS, ("withholding", "good taxpayer", "fuel perception", "domestic perception"), strict=True))


@query(
    "membership_risk",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS list, round(100 * avg(CAST(tier = 'Alto' AS INTEGER)) FILTER (WHERE {c} = 1), 10) AS inside_pct,
  round(100 * coalesce(avg(CAST(tier = 'Alto' AS INTEGER)) FILTER (WHERE {c} <> 1), 0), 10) AS outside_pct,
  count(*) FILTER (WHERE {c} = 1) AS invoices FROM predictions HAVING count(*) FILTER (WHERE {c} = 1) > 0"""
        for c, label in _LABELS.items()
    ),
    ("predictions",),
)
def membership_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dashboard.membership_risk(fx.predictions(spark, sf_dir), _LABELS)
    return table.withColumns({c: F.round(c, 10) for c in ("inside_pct", "outside_pct")})


@query(
    "filtered_predictions",
    f"""SELECT row_no, invoice_id, tier, doc_type, reasons FROM predictions
WHERE tier = 'Alto' AND doc_type = '1-URGENT' AND contains(reasons, 'Estado RUC')
  AND contains(lower(invoice_id || ' ' || coalesce(supplier_key || ' ', '') || {_NAME}), 'proveedor 1')""",
    ("predictions",),
)
def filtered_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = dashboard.filter_predictions(
        fx.predictions(spark, sf_dir),
        tier=S.TIER_HIGH,
        doc_type="1-URGENT",
        factor="Estado RUC irregular",
        text=" PROVEEDOR 1 ",
    )
    return filtered.select("row_no", "invoice_id", "tier", "doc_type", "reasons")


@query(
    "priority_queue",
    "SELECT row_no, invoice_id, probability, tier FROM predictions ORDER BY probability DESC, row_no LIMIT 50",
    ("predictions",),
)
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dashboard.priority_queue(fx.predictions(spark, sf_dir))
    return top.select("row_no", "invoice_id", "probability", "tier")


@query(
    "exported_rows",
    f"SELECT row_no, {_NAME} AS best_name, supplier_key, probability FROM predictions WHERE tier = 'Medio'",
    ("predictions",),
)
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = dashboard.filter_predictions(fx.predictions(spark, sf_dir), tier=S.TIER_MEDIUM)
    return dashboard.export_rows(filtered).select("row_no", "best_name", "supplier_key", "probability")


@query(
    "amount_sample",
    """SELECT row_no, amount, probability, tier FROM predictions WHERE amount > 0
ORDER BY md5(CAST(row_no AS VARCHAR) || ':42'), row_no LIMIT 4000""",
    ("predictions",),
)
def amount_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.amount_sample(fx.predictions(spark, sf_dir)).select("row_no", "amount", "probability", "tier")


@query(
    "critical_quadrant",
    """SELECT row_no, amount, probability FROM predictions
WHERE amount > (SELECT quantile_cont(amount, 0.5) FROM predictions WHERE amount > 0) AND probability >= 0.5""",
    ("predictions",),
)
def critical_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    critical = dashboard.critical_quadrant(fx.predictions(spark, sf_dir), fx.FIXED_THRESHOLD)
    return critical.select("row_no", "amount", "probability")
