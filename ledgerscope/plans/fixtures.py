"""The given tables seen as invoices, registry, lists and predictions.

Each view exists twice: as a DataFrame for Spark and as a SQL text (``SQL_VIEWS``) for the oracle.
Both are written from the same rules. Every order is an invoice; the registry lists the customers
outside one segment, so that some suppliers are not found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.risk import prediction_code, prediction_label, reasons_text, risk_reasons, risk_tier
from ledgerscope.functions.text import normalize_key
from ledgerscope.operators.enrich import (
    add_membership_flags,
    build_flags,
    definitive,
    derive_columns,
    distinct_keys,
    enrich_invoices,
    filter_registry,
    pending,
)
from ledgerscope.operators.skew import BROADCAST_ROWS, has_at_most

FIXED_CUTS = (0.33, 0.85)
FIXED_THRESHOLD = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(start: str, days: str) -> str:
    return f"CAST({start} AS TIMESTAMP) + make_dt_interval(CAST({days} AS INT))"


def invoices_from_orders(orders: DataFrame) -> DataFrame:
    issued = "CASE WHEN o_orderkey % 101 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END"
    due = _days("o_orderdate", "o_orderkey % 91 - 5")
    rows = orders.selectExpr(
        "o_orderkey AS row_no",
        """CASE WHEN o_orderkey % 307 = 0 THEN NULL
                WHEN o_orderkey % 211 = 0 THEN CAST(o_orderkey + 1 AS STRING)
                ELSE CAST(o_orderkey AS STRING) END AS invoice_id""",
        """CASE WHEN o_orderkey % 97 = 0 THEN NULL
                WHEN o_orderkey % 89 = 0 THEN 'n/a'
                WHEN o_orderkey % 2 = 1 THEN 'RUC ' || CAST(o_custkey AS STRING)
                ELSE CAST(o_custkey AS STRING) END AS raw_key""",
        """CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '   '
                ELSE ' Proveedor ' || CAST(o_custkey AS STRING) END AS supplier_name""",
        "o_orderpriority AS doc_type",
        """CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'USD' ELSE 'PEN' END AS currency""",
        f"{_days('o_orderdate', '-2')} AS created_ts",
        f"{issued} AS issued_ts",
        f"{due} AS due_ts",
        f"CASE WHEN o_orderstatus = 'F' THEN {_days('o_orderdate', '40')} END AS paid_ts",
        """CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN -o_totalprice
                ELSE o_totalprice END AS amount""",
        """CASE WHEN o_orderstatus = 'F' THEN 'Aceptada' WHEN o_orderstatus = 'P' THEN 'Pendiente / Borrador'
                WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Rechazada' ELSE 'Observada' END AS state""",
    )
    return rows.withColumn("supplier_key", normalize_key(F.col("raw_key")))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices_from_orders(table(spark, sf_dir, "orders"))


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry lines: customers outside one segment, with a later second line for rich ones."""
    listed = table(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    columns = (
        "CAST(c_custkey AS STRING) AS supplier_key",
        "' ' || c_name AS legal_name",
        "CASE WHEN c_acctbal < 0 THEN 'no  habido' ELSE 'Habido' END AS domicile",
        "CAST(c_nationkey AS STRING) AS location_code",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'AV.' ELSE '-' END AS street_type",
        "' ' || c_mktsegment || '  norte ' AS street_name",
        "CAST(c_custkey % 1000 AS STRING) AS street_number",
        "'-' AS interior",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'URB.' END AS zone_type",
    )
    first = listed.selectExpr(
        *columns,
        "CASE WHEN c_mktsegment = 'BUILDING' THEN ' suspension  temporal' ELSE 'activo' END AS key_status",
        "c_custkey AS line_no",
    )
    later = listed.where("c_acctbal > 5000").selectExpr(
        *columns,
        "CASE WHEN c_nationkey < 5 THEN 'baja de oficio' ELSE 'ACTIVO' END AS key_status",
        "c_custkey + 1000000000 AS line_no",
    )
    return first.unionByName(later)


def supplier_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """The suppliers of the invoices and whether they are few.

    The filtered registry and the flags have at most one row per supplier, so one check does for all.
    """
    keys = distinct_keys(invoices(spark, sf_dir))
    return keys, has_at_most(keys, BROADCAST_ROWS)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, few = supplier_keys(spark, sf_dir)
    return filter_registry(registry_raw(spark, sf_dir), keys, small=few)


def lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customers = table(spark, sf_dir, "customer").withColumn("supplier_key", normalize_key(F.col("c_custkey")))
    return {
        "is_withholding": customers.where("c_acctbal > 7000"),
        "is_good_taxpayer": customers.where("c_mktsegment = 'MACHINERY'"),
        "is_fuel_perception": customers.where("c_nationkey IN (1, 4, 9)"),
        "is_domestic_perception": customers.where("c_acctbal > 1000000"),
    }


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_flags(distinct_keys(invoices(spark, sf_dir)), lists(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, few = supplier_keys(spark, sf_dir)
    found = filter_registry(registry_raw(spark, sf_dir), keys, small=few)
    joined = enrich_invoices(invoices(spark, sf_dir), found, check_unique=False, small=few)
    return add_membership_flags(joined, build_flags(keys, lists(spark, sf_dir)), small=few)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice with all model features."""
    from ledgerscope.plans.pipeline import prepare

    keys, few = supplier_keys(spark, sf_dir)
    found = filter_registry(registry_raw(spark, sf_dir), keys, small=few)
    flagged = build_flags(keys, lists(spark, sf_dir))
    return prepare(invoices(spark, sf_dir), found, flagged, small=few, check_unique=False)


def _probability() -> F.Column:
    return F.expr("CAST((row_no * 7919) % 1000 AS DOUBLE) / 1000.0D")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and a deterministic score with many ties for every definitive invoice."""
    rows = derive_columns(definitive(invoices(spark, sf_dir)))
    return rows.select("row_no", "issued_ts", F.col("incident").alias("label"), _probability().alias("score"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending invoices with a deterministic probability, tier, label and reasons."""
    rows = pending(enriched(spark, sf_dir)).withColumns(
        {
            "probability": _probability(),
            "is_new_supplier": F.expr("CAST(row_no % 11 = 0 AS INT)"),
            "prev_incident_rate": F.expr("CAST((row_no * 31) % 100 AS DOUBLE) / 100.0D"),
            "amount_deviation": F.col("amount") - F.lit(250000.0),
        }
    )
    reasons = risk_reasons(
        *[F.col(c) for c in ("key_status", "domicile", "irregular", "is_new_supplier", "prev_incident_rate", "amount_deviation")]
    )
    code = prediction_code(F.col("probability"), FIXED_THRESHOLD)
    return rows.select(
        "row_no",
        F.coalesce("invoice_id", F.lit("")).alias("invoice_id"),
        "supplier_key",
        "supplier_name",
        "legal_name",
        "address",
        "doc_type",
        "issued_ts",
        "currency",
        "amount",
        "key_status",
        "domicile",
        "irregular",
        *S.LIST_FLAGS,
        "probability",
        code.alias("code"),
        prediction_label(code).alias("label"),
        risk_tier(F.col("probability"), *FIXED_CUTS).alias("tier"),
        reasons_text(reasons).alias("reasons"),
    )


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates and states of the orders written as untidy text."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_no",
        """CASE o_orderkey % 6 WHEN 0 THEN format_string('%.2f', o_totalprice)
                WHEN 1 THEN 'S/ ' || format_string('%.2f', o_totalprice)
                WHEN 2 THEN replace(format_string('%.2f', o_totalprice), '.', ',')
                WHEN 3 THEN 'n/a'
                WHEN 4 THEN '-1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '.5'
                ELSE '1.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || ',25' END AS amount_text""",
        """CASE o_orderkey % 9 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
                WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy')
                WHEN 3 THEN date_format(o_orderdate, 'dd/MM/yy') WHEN 4 THEN date_format(o_orderdate, 'yyyyMMdd')
                WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:20:30.250'
                WHEN 6 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:20:30Z'
                WHEN 7 THEN date_format(o_orderdate, 'yyyy-MM-dd') || ' 10:20:30-05:00' ELSE '?' END AS date_text""",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS us_date_text",
        """CASE o_orderkey % 9 WHEN 0 THEN 'ACEPTADA' WHEN 1 THEN 'Aceptado con observaciones'
                WHEN 2 THEN 'aceptada con observaciones' WHEN 3 THEN ' Recházado! ' WHEN 4 THEN 'CPE anulada'
                WHEN 5 THEN NULL WHEN 6 THEN 'En proceso' WHEN 7 THEN ' Otro Estado '
                ELSE 'pendiente/borrador' END AS state_text""",
        "'  Razón  Número ' || o_orderpriority || ' Ñandú  ' AS label_text",
    )


# --------------------------------------------------------------------------- the same in SQL
SQL_VIEWS = {
    "invoices": """
SELECT *, CASE WHEN length(regexp_replace(raw_key, '[^0-9]', '', 'g')) BETWEEN 1 AND 11
               THEN lpad(regexp_replace(raw_key, '[^0-9]', '', 'g'), 11, '0') END AS supplier_key
FROM (SELECT o_orderkey AS row_no,
  CASE WHEN o_orderkey % 307 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR)
       ELSE CAST(o_orderkey AS VARCHAR) END AS invoice_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'n/a'
       WHEN o_orderkey % 2 = 1 THEN 'RUC ' || CAST(o_custkey AS VARCHAR)
       ELSE CAST(o_custkey AS VARCHAR) END AS raw_key,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '   '
       ELSE ' Proveedor ' || CAST(o_custkey AS VARCHAR) END AS supplier_name,
  o_orderpriority AS doc_type,
  CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'USD' ELSE 'PEN' END AS currency,
  CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 DAY AS created_ts,
  CASE WHEN o_orderkey % 101 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS issued_ts,
  CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 91 - 5 AS INTEGER)) AS due_ts,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 40 DAY END AS paid_ts,
  CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN -o_totalprice
       ELSE o_totalprice END AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'Aceptada' WHEN o_orderstatus = 'P' THEN 'Pendiente / Borrador'
       WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Rechazada' ELSE 'Observada' END AS state
FROM orders)""",
    "registry_base": """
SELECT CAST(c_custkey AS VARCHAR) AS raw_id, ' ' || c_name AS legal_name,
  CASE WHEN c_acctbal < 0 THEN 'no  habido' ELSE 'Habido' END AS domicile,
  CAST(c_nationkey AS VARCHAR) AS location_code,
  CASE WHEN c_nationkey % 2 = 0 THEN 'AV.' ELSE '-' END AS street_type,
  ' ' || c_mktsegment || '  norte ' AS street_name, CAST(c_custkey % 1000 AS VARCHAR) AS street_number,
  '-' AS interior, CASE WHEN c_nationkey % 3 = 0 THEN 'URB.' END AS zone_type,
  c_custkey, c_acctbal, c_nationkey, c_mktsegment
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""",
    "registry_raw": """
SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN ' suspension  temporal' ELSE 'activo' END AS key_status,
  c_custkey AS line_no FROM registry_base
UNION ALL
SELECT *, CASE WHEN c_nationkey < 5 THEN 'baja de oficio' ELSE 'ACTIVO' END AS key_status,
  c_custkey + 1000000000 AS line_no FROM registry_base WHERE c_acctbal > 5000""",
    "registry_clean": """
SELECT lpad(raw_id, 11, '0') AS supplier_key, trim(legal_name) AS legal_name,
  upper(trim(regexp_replace(key_status, '\\s+', ' ', 'g'))) AS key_status,
  upper(trim(regexp_replace(domicile, '\\s+', ' ', 'g'))) AS domicile, location_code,
  trim(regexp_replace(concat_ws(' ', nullif(trim(street_type), '-'), nullif(trim(street_name), '-'),
    nullif(trim(street_number), '-'), nullif(trim(interior), '-'), nullif(trim(zone_type), '-')),
    '\\s+', ' ', 'g')) AS address,
  line_no, row_number() OVER (PARTITION BY raw_id ORDER BY line_no DESC) AS rn
FROM registry_raw""",
    "registry": """
SELECT supplier_key, legal_name, key_status, domicile, location_code, address,
  CASE WHEN key_status = 'ACTIVO' AND domicile = 'HABIDO' THEN 0 ELSE 1 END AS irregular
FROM registry_clean
WHERE rn = 1 AND supplier_key IN (SELECT supplier_key FROM invoices WHERE supplier_key IS NOT NULL)""",
    "flags": """
SELECT k.supplier_key, CAST(coalesce(c_acctbal > 7000, false) AS INTEGER) AS is_withholding,
  CAST(coalesce(c_mktsegment = 'MACHINERY', false) AS INTEGER) AS is_good_taxpayer,
  CAST(coalesce(c_nationkey IN (1, 4, 9), false) AS INTEGER) AS is_fuel_perception,
  0 AS is_domestic_perception
FROM (SELECT DISTINCT supplier_key FROM invoices WHERE supplier_key IS NOT NULL) k
LEFT JOIN customer c ON k.supplier_key = lpad(CAST(c.c_custkey AS VARCHAR), 11, '0')""",
    "enriched": """
SELECT i.*, CAST(r.supplier_key IS NOT NULL AS INTEGER) AS registry_found,
  coalesce(r.irregular, -1) AS irregular, coalesce(r.key_status, 'NO_ENCONTRADO') AS key_status,
  coalesce(r.domicile, 'NO_ENCONTRADO') AS domicile, r.legal_name, r.location_code, r.address,
  coalesce(f.is_withholding, 0) AS is_withholding, coalesce(f.is_good_taxpayer, 0) AS is_good_taxpayer,
  coalesce(f.is_fuel_perception, 0) AS is_fuel_perception,
  coalesce(f.is_domestic_perception, 0) AS is_domestic_perception
FROM invoices i LEFT JOIN registry r ON i.supplier_key = r.supplier_key
LEFT JOIN flags f ON i.supplier_key = f.supplier_key""",
    "derived": """
SELECT *, CAST(floor(date_diff('hour', issued_ts, due_ts) / 24.0) AS INTEGER) AS term_days,
  CAST(month(issued_ts) AS INTEGER) AS issue_month, CAST(year(issued_ts) AS INTEGER) AS issue_year,
  CAST(quarter(issued_ts) AS INTEGER) AS issue_quarter,
  CAST(isodow(issued_ts) - 1 AS INTEGER) AS issue_weekday, ln(1 + abs(amount)) AS log_amount,
  CASE WHEN state = 'Aceptada' THEN 0 WHEN state IN ('Observada', 'Rechazada') THEN 1 END AS incident
FROM enriched""",
    "scores": """
SELECT row_no, issued_ts, CASE WHEN state = 'Aceptada' THEN 0 ELSE 1 END AS label,
  CAST((row_no * 7919) % 1000 AS DOUBLE) / 1000.0 AS score
FROM invoices WHERE state IN ('Aceptada', 'Observada', 'Rechazada')""",
    "pred_inputs": """
SELECT *, CAST((row_no * 7919) % 1000 AS DOUBLE) / 1000.0 AS probability,
  row_no % 11 = 0 AS is_new, CAST((row_no * 31) % 100 AS DOUBLE) / 100.0 AS prev_rate
FROM enriched WHERE state IN ('Pendiente', 'Borrador', 'Pendiente / Borrador')""",
    "predictions": """
SELECT row_no, coalesce(invoice_id, '') AS invoice_id, supplier_key, supplier_name, legal_name, address, doc_type,
  issued_ts, currency, amount, key_status, domicile, irregular, is_withholding, is_good_taxpayer,
  is_fuel_perception, is_domestic_perception, probability,
  CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS code,
  CASE WHEN probability >= 0.5 THEN 'Riesgo de incidencia' ELSE 'Probablemente aceptada' END AS label,
  CASE WHEN probability < 0.33 THEN 'Bajo' WHEN probability < 0.85 THEN 'Medio' ELSE 'Alto' END AS tier,
  CASE WHEN len(rs) = 0 THEN 'Sin factores de riesgo destacados'
       ELSE array_to_string(rs[1:4], '; ') END AS reasons
FROM (SELECT *, list_filter([
    CASE WHEN key_status <> 'ACTIVO' THEN 'Estado RUC ' || key_status END,
    CASE WHEN domicile <> 'HABIDO' THEN 'Domicilio ' || domicile END,
    CASE WHEN irregular = 1 THEN 'Situacion tributaria irregular' END,
    CASE WHEN is_new THEN 'Proveedor sin historial previo' END,
    CASE WHEN prev_rate >= 0.2 THEN 'Historial previo con incidencias' END,
    CASE WHEN amount - 250000.0 > 0 THEN 'Importe sobre promedio historico' END],
    lambda x: x IS NOT NULL) AS rs FROM pred_inputs)""",
    "messy": """
SELECT o_orderkey AS row_no,
  CASE o_orderkey % 6 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN 'S/ ' || printf('%.2f', o_totalprice)
    WHEN 2 THEN replace(printf('%.2f', o_totalprice), '.', ',') WHEN 3 THEN 'n/a'
    WHEN 4 THEN '-1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.5'
    ELSE '1.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ',25' END AS amount_text,
  CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%y')
    WHEN 4 THEN strftime(o_orderdate, '%Y%m%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.250'
    WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30Z'
    WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30-05:00' ELSE '?' END AS date_text,
  strftime(o_orderdate, '%m/%d/%Y') AS us_date_text,
  CASE o_orderkey % 9 WHEN 0 THEN 'ACEPTADA' WHEN 1 THEN 'Aceptado con observaciones'
    WHEN 2 THEN 'aceptada con observaciones' WHEN 3 THEN ' Recházado! ' WHEN 4 THEN 'CPE anulada'
    WHEN 5 THEN NULL WHEN 6 THEN 'En proceso' WHEN 7 THEN ' Otro Estado '
    ELSE 'pendiente/borrador' END AS state_text,
  '  Razón  Número ' || o_orderpriority || ' Ñandú  ' AS label_text
FROM orders""",
}

_NEEDS = {
    "registry_raw": ("registry_base",),
    "registry_clean": ("registry_raw",),
    "registry": ("registry_clean", "invoices"),
    "flags": ("invoices",),
    "enriched": ("invoices", "registry", "flags"),
    "derived": ("enriched",),
    "scores": ("invoices",),
    "pred_inputs": ("enriched",),
    "predictions": ("pred_inputs",),
}


def with_views(sql: str, *views: str) -> str:
    """``sql`` preceded by the definitions of the views it reads."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            visit(needed)
        if name not in order:
            order.append(name)

    for view in views:
        visit(view)
    if not order:
        return sql
    definitions = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in order)
    body = sql.strip()
    joiner = ",\n" + body[len("WITH ") :] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {definitions}{joiner}"


# --------------------------------------------------------------------------- several scored models
# experiment, model, multiplier of the pseudo random part, weight of the label in the score
MODEL_SCORES = (
    ("base", "dummy", 0, 0),
    ("base", "linear", 7919, 60),
    ("base", "forest", 6151, 200),
    ("extended", "dummy", 0, 0),
    ("extended", "linear", 4409, 150),
    ("extended", "forest", 3571, 190),
)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of several pretended models for every definitive invoice."""
    entries = F.array(
        *[
            F.struct(
                F.lit(e).alias("experiment"),
                F.lit(m).alias("model"),
                F.expr(f"CAST((row_no * {k}) % 1000 + label * {w} AS DOUBLE) / 1250.0D").alias("score"),
            )
            for e, m, k, w in MODEL_SCORES
        ]
    )
    rows = scores(spark, sf_dir).drop("score")
    return rows.select("row_no", "issued_ts", "label", F.inline(entries))


SQL_VIEWS["model_scores"] = "\nUNION ALL\n".join(
    f"SELECT row_no, issued_ts, label, '{e}' AS experiment, '{m}' AS model, "
    f"CAST((row_no * {k}) % 1000 + label * {w} AS DOUBLE) / 1250.0 AS score FROM scores"
    for e, m, k, w in MODEL_SCORES
)
_NEEDS["model_scores"] = ("scores",)
