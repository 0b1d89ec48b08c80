"""Queries over the cleaning, profile and summary operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import text
from ledgerscope.functions.temporal import parse_date_columns
from ledgerscope.operators import enrich, profile, summary
from ledgerscope.plans import fixtures as fx
from ledgerscope.plans.registry import query


@query(
    "normalized_keys",
    "SELECT row_no, raw_key, supplier_key FROM invoices",
    ("invoices",),
)
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.invoices(spark, sf_dir).select("row_no", "raw_key", "supplier_key")


@query(
    "distinct_supplier_keys",
    "SELECT DISTINCT supplier_key FROM invoices WHERE supplier_key IS NOT NULL",
    ("invoices",),
)
def distinct_supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.distinct_keys(fx.invoices(spark, sf_dir))


@query(
    "parsed_amounts",
    r"""
SELECT row_no, amount_text, TRY_CAST(CASE WHEN regexp_matches(kept, ',[0-9]{1,2}$')
    THEN replace(replace(kept, '.', ''), ',', '.') ELSE replace(kept, ',', '') END AS DOUBLE) AS amount
FROM (SELECT *, regexp_replace(amount_text, '[^0-9,.\-]', '', 'g') AS kept FROM messy)""",
    ("messy",),
)
def parsed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messy(spark, sf_dir)
    return rows.select("row_no", "amount_text", text.parse_amount(F.col("amount_text")).alias("amount"))


@query(
    "parsed_dates",
    """
SELECT row_no, coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%y'),
    try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%d-%m-%Y'), try_strptime(date_text, '%Y%m%d'),
    try_strptime(date_text, '%Y-%m-%dT%H:%M:%S.%g'), try_strptime(date_text, '%Y-%m-%dT%H:%M:%SZ'),
    try_strptime(date_text, '%Y-%m-%d %H:%M:%S-05:00') + INTERVAL 5 HOUR) AS date_text, try_strptime(us_date_text, '%m/%d/%Y') AS us_date_text
FROM messy""",
    ("messy",),
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messy(spark, sf_dir).select("row_no", "date_text", "us_date_text")
    return parse_date_columns(rows, ["date_text", "us_date_text"])


@query(
    "normalized_states",
    r"""
SELECT row_no, state_text, CASE WHEN t IS NULL THEN 'Pendiente / Borrador'
  WHEN t IN ('aceptada', 'aceptado', 'accepted') THEN 'Aceptada'
  WHEN t IN ('observada', 'observado', 'aceptada con observaciones') THEN 'Observada'
  WHEN t IN ('rechazada', 'rechazado', 'rejected', 'anulada') THEN 'Rechazada'
  WHEN t IN ('pendiente', 'borrador', 'pendiente borrador', 'en proceso', 'por enviar') THEN 'Pendiente / Borrador'
  WHEN regexp_matches(t, 'aceptada|aceptado|accepted') THEN 'Aceptada'
  WHEN regexp_matches(t, 'observada|observado') THEN 'Observada'
  WHEN regexp_matches(t, 'rechazada|rechazado|rejected|anulada') THEN 'Rechazada'
  WHEN regexp_matches(t, 'pendiente|borrador|en proceso|por enviar') THEN 'Pendiente / Borrador'
  ELSE trim(state_text) END AS state
FROM (SELECT *, trim(regexp_replace(strip_accents(lower(state_text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM messy)""",
    ("messy",),
)
def normalized_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messy(spark, sf_dir)
    return rows.select("row_no", "state_text", text.normalize_state(F.col("state_text")).alias("state"))


@query(
    "ascii_text",
    r"""
SELECT row_no, trim(regexp_replace(strip_accents(lower(label_text)), '[^a-z0-9]+', ' ', 'g')) AS ascii_text,
  regexp_replace(regexp_replace(translate(upper(trim(label_text)), 'ÁÉÍÓÚÑ', 'AEIOUN'), '[^A-Z0-9]+', '_', 'g'),
    '^_+|_+$', '', 'g') AS header_name
FROM messy""",
    ("messy",),
)
def ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label_text")
    rows = fx.messy(spark, sf_dir)
    return rows.select("row_no", text.ascii_text(label).alias("ascii_text"), text.upper_name(label).alias("header_name"))


@query(
    "document_ascii_text",
    r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(
  translate(strip_accents(lower(text)), 'ıłøđæœßþðħŋŧ', ''), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS text_hash
FROM documents""",
)
def document_ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(text.ascii_text(F.col("text"))).alias("text_hash"))


@query(
    "clean_upper_text",
    r"""SELECT row_no, upper(trim(regexp_replace(coalesce(state_text, ''), '\s+', ' ', 'g'))) AS state_text,
  upper(trim(regexp_replace(coalesce(label_text, ''), '\s+', ' ', 'g'))) AS label_text FROM messy""",
    ("messy",),
)
def clean_upper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.messy(spark, sf_dir)
    return rows.select("row_no", *[text.clean_upper(F.col(c)).alias(c) for c in ("state_text", "label_text")])


@query(
    "generated_ids",
    """SELECT row_no, 'IMP-' || lpad(CAST(row_number() OVER (ORDER BY row_no) - 1 AS VARCHAR), 8, '0') AS invoice_id,
  coalesce(currency, 'No especificado') AS currency, issued_ts AS due_ts FROM invoices""",
    ("invoices",),
)
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerscope.sources.importing import default_columns, generate_ids

    bare = fx.invoices(spark, sf_dir).select("row_no", "issued_ts", "currency")
    return default_columns(generate_ids(bare, "row_no")).select("row_no", "invoice_id", "currency", "due_ts")


# --------------------------------------------------------------------------- profile
@query(
    "null_counts",
    """SELECT unnest(['row_no','invoice_id','raw_key','supplier_name','doc_type','currency','created_ts','issued_ts',
  'due_ts','paid_ts','amount','state','supplier_key']) AS column_name,
  unnest([n - count(row_no), n - count(invoice_id), n - count(raw_key), n - count(supplier_name), n - count(doc_type),
  n - count(currency), n - count(created_ts), n - count(issued_ts), n - count(due_ts), n - count(paid_ts),
  n - count(amount), n - count(state), n - count(supplier_key)]) AS nulls
FROM invoices, (SELECT count(*) AS n FROM orders) GROUP BY n""",
    ("invoices",),
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(fx.invoices(spark, sf_dir))


@query(
    "key_quality",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE ok) AS valid_keys, count(*) FILTER (WHERE NOT ok) AS invalid_keys,
  count(DISTINCT CASE WHEN ok THEN k END) AS unique_valid_keys
FROM (SELECT k, coalesce(regexp_full_match(trim(k), '[0-9]{11}'), false) AS ok
      FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN supplier_key ELSE raw_key END AS k
            FROM invoices JOIN orders ON row_no = o_orderkey))""",
    ("invoices",),
)
def key_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.expr("CASE WHEN row_no % 3 = 0 THEN supplier_key ELSE raw_key END")
    return profile.key_quality(fx.invoices(spark, sf_dir).withColumn("raw_key", mixed))


@query(
    "date_ranges",
    """
SELECT column_name, CAST(min(v) AS DATE) AS first_day, CAST(max(v) AS DATE) AS last_day,
  count(*) - count(v) AS missing,
  count(*) FILTER (WHERE v < TIMESTAMP '1990-01-01' OR v > TIMESTAMP '2100-12-31') AS out_of_range
FROM (SELECT 'created_ts' AS column_name, created_ts AS v FROM invoices
      UNION ALL SELECT 'issued_ts', issued_ts FROM invoices UNION ALL SELECT 'due_ts', due_ts FROM invoices
      UNION ALL SELECT 'paid_ts', paid_ts FROM invoices) GROUP BY column_name""",
    ("invoices",),
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.date_ranges(fx.invoices(spark, sf_dir))


@query(
    "amount_describe",
    """
SELECT column_name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max
FROM (SELECT 'amount' AS column_name, amount AS v FROM derived
      UNION ALL SELECT 'term_days', CAST(term_days AS DOUBLE) FROM derived) GROUP BY column_name""",
    ("derived",),
)
def amount_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.derive_columns(fx.invoices(spark, sf_dir)).select("amount", "term_days")
    stats = profile.describe_numeric(rows, ["amount", "term_days"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("state_distribution", "SELECT state, count(*) AS n FROM invoices GROUP BY state", ("invoices",))
def state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(fx.invoices(spark, sf_dir), "state")


_QUALITY_SQL = """
WITH flagged AS (SELECT row_no, invoice_id, 'negative_amount' AS rule FROM invoices WHERE amount < 0
  UNION ALL SELECT row_no, invoice_id, 'due_before_issue' FROM invoices WHERE due_ts < issued_ts
  UNION ALL SELECT row_no, invoice_id, 'date_out_of_range' FROM invoices
    WHERE least(created_ts, issued_ts, due_ts, paid_ts) < TIMESTAMP '1990-01-01'
       OR greatest(created_ts, issued_ts, due_ts, paid_ts) > TIMESTAMP '2100-12-31'
  UNION ALL SELECT row_no, invoice_id, 'amount_not_countable' FROM invoices
    WHERE amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(38, 6)) IS NULL),
firsts AS (SELECT rule, array_to_string(list_filter(list(invoice_id ORDER BY row_no), lambda x: x IS NOT NULL), ',') AS examples
  FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY row_no) AS rn FROM flagged) WHERE rn <= 20 GROUP BY rule),
totals AS (SELECT rule, count(*) AS n FROM flagged GROUP BY rule)
SELECT d.rule, coalesce(t.n, 0) AS rows, coalesce(f.examples, '') AS examples
FROM (SELECT unnest(['negative_amount', 'due_before_issue', 'date_out_of_range', 'amount_not_countable']) AS rule) d
LEFT JOIN totals t ON d.rule = t.rule LEFT JOIN firsts f ON d.rule = f.rule"""


@query("quality_issues", _QUALITY_SQL, ("invoices",))
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality_issues(fx.invoices(spark, sf_dir), uncountable=True)


@query(
    "duplicate_ids",
    """
WITH g AS (SELECT invoice_id, count(*) AS n, count(supplier_key) AS k FROM invoices GROUP BY invoice_id)
SELECT count(*) FILTER (WHERE invoice_id IS NOT NULL AND k > 1) AS repeated_ids,
  CAST(coalesce(sum(k - 1) FILTER (WHERE invoice_id IS NOT NULL AND k > 1), 0) AS BIGINT) AS surplus_rows,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups,
  count(*) FILTER (WHERE invoice_id IS NOT NULL AND n > 1) AS distinct_in_groups FROM g""",
    ("invoices",),
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_ids(fx.invoices(spark, sf_dir))


@query(
    "top_duplicate_ids",
    """SELECT invoice_id, count(*) AS n FROM invoices GROUP BY invoice_id HAVING count(*) > 1
ORDER BY n DESC, invoice_id NULLS LAST LIMIT 20""",
    ("invoices",),
)
def top_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_duplicate_ids(fx.invoices(spark, sf_dir))


@query(
    "dataset_summary",
    """SELECT count(*) AS rows, count(DISTINCT supplier_key) AS suppliers, CAST(min(issued_ts) AS DATE) AS first_day,
  CAST(max(issued_ts) AS DATE) AS last_day FROM invoices""",
    ("invoices",),
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_summary(fx.invoices(spark, sf_dir))


# --------------------------------------------------------------------------- supplier summary
SUMMARY_SQL = """
WITH summary AS (SELECT supplier_key, count(*) AS invoices,
  count(*) FILTER (WHERE state = 'Aceptada') AS accepted, count(*) FILTER (WHERE state = 'Observada') AS observed,
  count(*) FILTER (WHERE state = 'Rechazada') AS rejected,
  count(*) FILTER (WHERE state IN ('Pendiente', 'Borrador', 'Pendiente / Borrador')) AS pending,
  CAST(coalesce(sum(TRY_CAST(amount AS DECIMAL(38, 6))), 0) AS DOUBLE) AS amount_sum, count(amount) AS amount_count,
  min(issued_ts) AS first_issued, max(issued_ts) AS last_issued
  FROM invoices WHERE supplier_key IS NOT NULL GROUP BY supplier_key),
finished AS (SELECT *, observed + rejected AS incidents,
  CASE WHEN accepted + observed + rejected > 0
    THEN CAST(observed + rejected AS DOUBLE) / (accepted + observed + rejected) END AS incident_rate,
  CASE WHEN amount_count > 0 THEN amount_sum / amount_count END AS mean_amount FROM summary)
"""


def summary_sql(select: str) -> str:
    return SUMMARY_SQL + select


@query("supplier_summary", summary_sql("SELECT * FROM finished"), ("invoices",))
def supplier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = summary.clean_history(fx.invoices(spark, sf_dir))
    return summary.by_risk(summary.supplier_summary(cleaned))


@query(
    "summary_totals",
    summary_sql(
        """SELECT count(*) AS suppliers, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(observed) AS BIGINT) AS observed,
  CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(pending) AS BIGINT) AS pending FROM finished"""
    ),
    ("invoices",),
)
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary_totals(summary.supplier_summary(summary.clean_history(fx.invoices(spark, sf_dir))))


@query(
    "top_risk_suppliers",
    summary_sql(
        """SELECT supplier_key, invoices, incidents, incident_rate FROM finished
ORDER BY incident_rate DESC NULLS LAST, invoices DESC, supplier_key LIMIT 10"""
    ),
    ("invoices",),
)
def top_risk_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = summary.clean_history(fx.invoices(spark, sf_dir))
    return summary.top_risk_suppliers(summary.supplier_summary(cleaned))
