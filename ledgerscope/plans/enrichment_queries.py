"""Queries over the registry, membership, upsert and history operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import enrich, history
from ledgerscope.plans import fixtures as fx
from ledgerscope.plans.registry import query
from ledgerscope.sources import bucketed


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.derive_columns(fx.enriched(spark, sf_dir))


# --------------------------------------------------------------------------- registry
@query(
    "composed_address",
    "SELECT CAST(line_no AS BIGINT) AS line_no, address FROM registry_clean",
    ("registry_clean",),
)
def composed_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerscope.functions.text import join_address

    raw = fx.registry_raw(spark, sf_dir)
    parts = [F.col(c) for c in S.ADDRESS_PARTS if c in raw.columns]
    return raw.select("line_no", join_address(*parts).alias("address"))


@query("registry_filtered", "SELECT * FROM registry", ("registry",))
def registry_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.registry(spark, sf_dir)


@query(
    "registry_semi",
    """SELECT CAST(line_no AS BIGINT) AS line_no, lpad(raw_id, 11, '0') AS supplier_key FROM registry_raw
WHERE lpad(raw_id, 11, '0') IN (SELECT supplier_key FROM invoices WHERE state = 'Rechazada')""",
    ("registry_raw", "invoices"),
)
def registry_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerscope.functions.text import normalize_key
    from ledgerscope.operators.skew import semi_join_keys

    rejected = enrich.distinct_keys(fx.invoices(spark, sf_dir).where(F.col("state") == S.REJECTED))
    raw = fx.registry_raw(spark, sf_dir).withColumn("supplier_key", normalize_key(F.col("supplier_key")))
    return semi_join_keys(raw, rejected, "supplier_key").select("line_no", "supplier_key")


@query(
    "invoices_of_listed",
    """SELECT row_no, supplier_key FROM invoices
WHERE supplier_key IN (SELECT lpad(raw_id, 11, '0') FROM registry_raw WHERE raw_id IS NOT NULL)""",
    ("registry_raw", "invoices"),
)
def invoices_of_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of suppliers in the registry, by the way for lists that are too long to broadcast."""
    from ledgerscope.functions.text import normalize_key
    from ledgerscope.operators.skew import semi_join_keys

    listed = fx.registry_raw(spark, sf_dir).select(normalize_key(F.col("supplier_key")).alias("supplier_key"))
    return semi_join_keys(fx.invoices(spark, sf_dir).select("row_no", "supplier_key"), listed, "supplier_key", small=False)


@query(
    "missing_keys",
    """SELECT DISTINCT supplier_key FROM invoices WHERE supplier_key IS NOT NULL
AND supplier_key NOT IN (SELECT supplier_key FROM registry)""",
    ("registry",),
)
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = enrich.distinct_keys(fx.invoices(spark, sf_dir))
    return enrich.missing_keys(wanted, fx.registry(spark, sf_dir))


@query(
    "registry_report",
    """SELECT count(*) AS wanted, count(r.irregular) AS found, count(*) - count(r.irregular) AS missing,
  count(*) FILTER (WHERE r.irregular = 0) AS regular, count(*) FILTER (WHERE r.irregular = 1) AS irregular
FROM (SELECT DISTINCT supplier_key FROM invoices WHERE supplier_key IS NOT NULL) k
LEFT JOIN registry r ON k.supplier_key = r.supplier_key""",
    ("registry",),
)
def registry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.registry_report(enrich.distinct_keys(fx.invoices(spark, sf_dir)), fx.registry(spark, sf_dir))


_DIMENSION_SQL = """
SELECT supplier_key, trim(legal_name) AS legal_name, key_status, domicile, location_code,
  CAST(NULL AS VARCHAR) AS address, irregular, CAST(NULL AS DATE) AS queried_on, CAST(NULL AS VARCHAR) AS source
FROM (SELECT lpad(raw_id, 11, '0') AS supplier_key, legal_name, key_status, domicile, location_code,
        CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey % 2 END AS irregular,
        row_number() OVER (PARTITION BY raw_id ORDER BY line_no DESC) AS rn FROM registry_raw) WHERE rn = 1"""


@query("normalized_dimension", _DIMENSION_SQL.replace("trim(legal_name)", "legal_name"), ("registry_raw",))
def normalized_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    irregular = F.expr(
        "CASE WHEN CAST(location_code AS INT) % 4 = 0 THEN 'x' ELSE CAST(CAST(location_code AS INT) % 2 AS STRING) END"
    )
    raw = fx.registry_raw(spark, sf_dir).withColumn("irregular", irregular)
    return enrich.normalize_dimension(raw, "line_no")


@query(
    "dedup_keep_last",
    """SELECT raw_id AS supplier_key, key_status, CAST(line_no AS BIGINT) AS line_no, 'last' AS kept FROM registry_raw
QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY line_no DESC) = 1
UNION ALL
SELECT raw_id, key_status, CAST(line_no AS BIGINT), 'first' FROM registry_raw
QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY line_no) = 1""",
    ("registry_raw",),
)
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.registry_raw(spark, sf_dir).select("supplier_key", "key_status", "line_no")
    kept = [
        enrich.dedup_by_key(raw, "supplier_key", "line_no", keep=k).withColumn("kept", F.lit(k)) for k in ("last", "first")
    ]
    return kept[0].unionByName(kept[1])


@query(
    "enriched_invoices",
    """SELECT row_no, supplier_key, amount, registry_found, irregular, key_status, domicile, legal_name, location_code,
  address FROM enriched""",
    ("enriched",),
)
def enriched_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, few = fx.supplier_keys(spark, sf_dir)
    found = enrich.filter_registry(fx.registry_raw(spark, sf_dir), keys, small=few)
    joined = enrich.enrich_invoices(fx.invoices(spark, sf_dir), found, small=few)
    return joined.select(
        "row_no", "supplier_key", "amount", "registry_found", "irregular", "key_status", "domicile", "legal_name",
        "location_code", "address",
    )


_BOTH_SQL = (
    "SELECT row_no, supplier_key, registry_found, irregular, key_status, domicile, " + ", ".join(S.LIST_FLAGS) + " FROM enriched"
)
_BOTH = ("row_no", "supplier_key", "registry_found", "irregular", "key_status", "domicile", *S.LIST_FLAGS)


@query("enriched_invoices_bucketed", _BOTH_SQL, ("enriched",))
def enriched_invoices_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry and flags joined to invoices that lie in the same buckets: no shuffle of either."""
    facts = bucketed.bucketed_facts(fx.invoices(spark, sf_dir), "invoices", "supplier_key", "row_no")
    keys = fx.supplier_keys(spark, sf_dir)[0]
    dim = enrich.merged_dimension(fx.registry(spark, sf_dir), enrich.build_flags(keys, fx.lists(spark, sf_dir)))
    joined = bucketed.bucketed_join(facts, bucketed.bucketed_dimension(dim, "dimension", "supplier_key"), "supplier_key")
    return enrich.fill_dimension(joined).select(*_BOTH)


@query("enriched_invoices_large_dimension", _BOTH_SQL, ("enriched",))
def enriched_invoices_large_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry and flags, too large to broadcast, in one join with hot suppliers set apart."""
    keys = fx.supplier_keys(spark, sf_dir)[0]
    flags = enrich.build_flags(keys, fx.lists(spark, sf_dir))
    joined = enrich.enrich_with_flags(
        fx.invoices(spark, sf_dir), fx.registry(spark, sf_dir), flags, check_unique=False, broadcast_rows=0, hot_rows=15
    )
    return joined.select(*_BOTH)


@query(
    "enrichment_stats",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE registry_found = 1) AS rows_found,
  count(*) FILTER (WHERE registry_found = 0) AS rows_missing,
  count(DISTINCT supplier_key) FILTER (WHERE registry_found = 1) AS suppliers_found,
  count(DISTINCT supplier_key) FILTER (WHERE registry_found = 0) AS suppliers_missing FROM enriched""",
    ("enriched",),
)
def enrichment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrichment_stats(
        enrich.enrich_invoices(fx.invoices(spark, sf_dir), fx.registry(spark, sf_dir), check_unique=False)
    )


@query("membership_flags", f"SELECT row_no, supplier_key, {', '.join(S.LIST_FLAGS)} FROM enriched", ("enriched",))
def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = enrich.add_membership_flags(fx.invoices(spark, sf_dir), fx.flags(spark, sf_dir))
    return flagged.select("row_no", "supplier_key", *S.LIST_FLAGS)


@query(
    "membership_coverage",
    f"SELECT {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in S.LIST_FLAGS)} FROM flags",
    ("flags",),
)
def membership_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerscope.operators.dashboard import membership_coverage

    return membership_coverage(fx.flags(spark, sf_dir))


# --------------------------------------------------------------------------- upsert
_FLAG_LIST = ", ".join(S.LIST_FLAGS)
_UPSERT_SQL = f"""
WITH lines AS (SELECT lpad(raw_id, 11, '0') AS supplier_key, nullif(trim(legal_name), '') AS legal_name,
    trim(key_status) AS key_status, trim(domicile) AS domicile, location_code, c_nationkey, c_mktsegment, line_no,
    row_number() OVER (PARTITION BY raw_id ORDER BY line_no) AS first_rn,
    row_number() OVER (PARTITION BY raw_id ORDER BY line_no DESC) AS last_rn FROM registry_raw),
target AS (SELECT *, NULL AS address, c_nationkey % 2 AS irregular, DATE '2024-01-31' AS queried_on, 'base' AS source,
    1 AS is_withholding, 0 AS is_good_taxpayer, NULL AS is_fuel_perception, 0 AS is_domestic_perception
  FROM lines WHERE first_rn = 1 AND c_mktsegment <> 'FURNITURE'),
src AS (SELECT l.supplier_key, legal_name, key_status, domicile, location_code, NULL AS address,
    c_nationkey % 2 AS irregular, DATE '2024-01-31' AS queried_on, 'base' AS source, f.*
  FROM lines l LEFT JOIN (SELECT supplier_key AS fk, {_FLAG_LIST} FROM flags) f ON l.supplier_key = f.fk
  WHERE last_rn = 1 AND c_mktsegment <> 'MACHINERY'),
merged AS (SELECT coalesce(s.supplier_key, t.supplier_key) AS supplier_key,
    {", ".join(f"CASE WHEN s.supplier_key IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in ("legal_name", "key_status", "domicile", "location_code", "address", "irregular", "queried_on", "source"))},
    {", ".join(f"coalesce(s.{c}, t.{c}) AS {c}" for c in S.LIST_FLAGS)},
    CASE WHEN s.supplier_key IS NULL THEN 'kept' WHEN t.supplier_key IS NULL THEN 'inserted'
      WHEN {" AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in ("legal_name", "key_status", "domicile", "location_code", "irregular"))}
       AND {" AND ".join(f"coalesce(s.{c}, t.{c}) IS NOT DISTINCT FROM t.{c}" for c in S.LIST_FLAGS)} THEN 'unchanged'
      ELSE 'updated' END AS action
  FROM src s FULL JOIN target t ON s.supplier_key = t.supplier_key)
"""


def _upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = fx.registry_raw(spark, sf_dir).withColumns(
        {
            "irregular": F.expr("CAST(location_code AS INT) % 2"),
            "queried_on": F.lit("2024-01-31"),
            "source": F.lit("base"),
            "address": F.lit("  "),
        }
    )
    old = enrich.dedup_by_key(raw, "supplier_key", "line_no", keep="first")
    target = enrich.prepare_upsert_source(old.where(~F.col("street_name").contains("FURNITURE")), None, "line_no")
    target = target.withColumns(
        {
            "is_withholding": F.lit(1),
            "is_good_taxpayer": F.lit(0),
            "is_fuel_perception": F.lit(None).cast("int"),
            "is_domestic_perception": F.lit(0),
        }
    )
    new = raw.where(~F.col("street_name").contains("MACHINERY"))
    return target, enrich.prepare_upsert_source(new, fx.flags(spark, sf_dir), "line_no")


@query(
    "upsert_merged",
    _UPSERT_SQL
    + f"""SELECT supplier_key, legal_name, key_status, domicile, location_code, CAST(address AS VARCHAR) AS address,
  CAST(irregular AS INTEGER) AS irregular, queried_on, source, {_FLAG_LIST}, action FROM merged""",
    ("registry_raw", "flags"),
)
def upsert_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.classify_upsert(*_upsert_sides(spark, sf_dir))


@query(
    "upsert_stats",
    _UPSERT_SQL
    + """SELECT count(*) FILTER (WHERE action <> 'kept') AS read, count(*) FILTER (WHERE action = 'inserted') AS inserted,
  count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'unchanged') AS unchanged
FROM merged""",
    ("registry_raw", "flags"),
)
def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.upsert_stats(enrich.classify_upsert(*_upsert_sides(spark, sf_dir)))


# --------------------------------------------------------------------------- derived columns
@query(
    "derived_columns",
    """SELECT row_no, term_days, issue_month, issue_year, issue_quarter, issue_weekday,
  round(log_amount, 9) AS log_amount FROM derived""",
    ("derived",),
)
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select(
        "row_no", "term_days", "issue_month", "issue_year", "issue_quarter", "issue_weekday",
        F.round("log_amount", 9).alias("log_amount"),
    )


@query("target_labels", "SELECT row_no, state, incident FROM derived", ("derived",))
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.derive_columns(fx.invoices(spark, sf_dir)).select("row_no", "state", "incident")


@query("definitive_rows", "SELECT row_no, state FROM invoices WHERE state <> 'Pendiente / Borrador'", ("invoices",))
def definitive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.definitive(fx.invoices(spark, sf_dir)).select("row_no", "state")


@query("pending_rows", "SELECT row_no, state FROM invoices WHERE state = 'Pendiente / Borrador'", ("invoices",))
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.pending(fx.invoices(spark, sf_dir)).select("row_no", "state")


_WATCHED = (
    "supplier_key", "amount", "issued_ts", "due_ts", "term_days", "irregular", "key_status", "domicile",
    "registry_found", "incident",
)


@query(
    "prep_report",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE d) AS definitive, count(*) FILTER (WHERE NOT d) AS pending,
  count(*) FILTER (WHERE registry_found = 1) AS rows_found, count(*) FILTER (WHERE registry_found = 0) AS rows_missing,
  count(DISTINCT supplier_key) FILTER (WHERE registry_found = 1) AS suppliers_found,
  count(DISTINCT supplier_key) FILTER (WHERE registry_found = 0) AS suppliers_missing,
  count(*) FILTER (WHERE d AND incident = 0) AS clean, count(*) FILTER (WHERE d AND incident = 1) AS incidents,
  round(100.0 * CAST(count(*) FILTER (WHERE d AND incident = 1) AS DOUBLE) / count(*) FILTER (WHERE d), 4) AS incident_pct,
  {", ".join(f"count(*) - count({c}) AS null_{c}" for c in _WATCHED)}
FROM (SELECT *, state <> 'Pendiente / Borrador' AS d FROM derived)""",
    ("derived",),
)
def prep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.preparation_report(_prepared(spark, sf_dir))


# --------------------------------------------------------------------------- history
_PRIOR_SQL = """
prior AS (SELECT day, coalesce(sum(s) OVER w, 0) AS prior_incidents, coalesce(sum(k) OVER w, 0) AS prior_known
  FROM (SELECT CAST(issued_ts AS DATE) AS day, coalesce(sum(incident), 0) AS s, count(incident) AS k
        FROM derived WHERE issued_ts IS NOT NULL GROUP BY 1)
  WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (SELECT *, CASE WHEN prior_known > 0 THEN CAST(prior_incidents AS DOUBLE) / prior_known ELSE 0.0 END AS prior_rate
  FROM prior),
all_rates AS (SELECT * FROM rates UNION ALL
  SELECT NULL, prior_incidents, prior_known, prior_rate FROM (SELECT * FROM rates ORDER BY day DESC LIMIT 1))
"""


@query(
    "daily_prior",
    f"""WITH {_PRIOR_SQL.strip()}
SELECT day, CAST(prior_incidents AS BIGINT) AS prior_incidents, CAST(prior_known AS BIGINT) AS prior_known, prior_rate
FROM all_rates""",
    ("derived",),
)
def daily_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.daily_prior(enrich.derive_columns(fx.invoices(spark, sf_dir)))


def _history_sql(no_past: str) -> str:
    return f"""
WITH {_PRIOR_SQL.strip()},
mid AS (SELECT quantile_cont(amount, 0.5) AS m FROM invoices),
day_amounts AS (SELECT CAST(issued_ts AS DATE) AS day, sum(TRY_CAST(amount AS DECIMAL(38, 6))) AS s, count(amount) AS n
  FROM derived GROUP BY 1),
past AS (SELECT day, CASE WHEN sum(n) OVER w > 0 THEN CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w ELSE 0.0 END AS past_mean
  FROM day_amounts WINDOW w AS (ORDER BY day NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, row_number() OVER o - 1 AS n_prev, coalesce(sum(incident) OVER p, 0) AS inc_prev,
    count(incident) OVER p AS known_prev, sum(TRY_CAST(amount AS DECIMAL(38, 6))) OVER p AS amt_prev,
    count(amount) OVER p AS amt_n, max(TRY_CAST(amount AS DECIMAL(38, 6))) OVER p AS amt_max,
    lag(issued_ts) OVER o AS prev_ts,
    count(*) OVER r30 AS old_n30, coalesce(sum(incident) OVER r30, 0) AS old_i30,
    count(*) OVER r90 AS old_n90, coalesce(sum(incident) OVER r90, 0) AS old_i90
  FROM (SELECT *, coalesce(epoch_us(issued_ts), 9000000000000000000) AS ts_us FROM derived)
  WINDOW o AS (PARTITION BY supplier_key ORDER BY ts_us, row_no),
    p AS (PARTITION BY supplier_key ORDER BY ts_us, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r30 AS (PARTITION BY supplier_key ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 2592000000001 PRECEDING),
    r90 AS (PARTITION BY supplier_key ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 7776000000001 PRECEDING)),
h AS (SELECT w.*, r.prior_rate, {no_past} AS no_past
  FROM w LEFT JOIN all_rates r ON CAST(w.issued_ts AS DATE) IS NOT DISTINCT FROM r.day
  LEFT JOIN past ON CAST(w.issued_ts AS DATE) IS NOT DISTINCT FROM past.day),
features AS (SELECT row_no, supplier_key, incident, n_prev AS prev_count, CAST(inc_prev AS BIGINT) AS prev_incidents,
  (CAST(inc_prev AS DOUBLE) + prior_rate * 5.0) / (known_prev + 5.0) AS prev_incident_rate,
  coalesce(CAST(amt_prev AS DOUBLE) / nullif(amt_n, 0), no_past) AS prev_mean_amount,
  coalesce(CAST(amt_max AS DOUBLE), no_past) AS prev_max_amount,
  CAST(coalesce(floor((epoch_us(issued_ts) - epoch_us(prev_ts)) / 86400000000.0), 9999) AS INTEGER) AS days_since_prev,
  CASE WHEN issued_ts IS NULL THEN 0 ELSE CAST(inc_prev - old_i30 AS BIGINT) END AS incidents_30d,
  CASE WHEN issued_ts IS NULL THEN 0 ELSE CAST(inc_prev - old_i90 AS BIGINT) END AS incidents_90d,
  CASE WHEN issued_ts IS NULL THEN 0 ELSE n_prev - old_n30 END AS invoices_30d,
  CASE WHEN issued_ts IS NULL THEN 0 ELSE n_prev - old_n90 END AS invoices_90d,
  coalesce(amount - coalesce(CAST(amt_prev AS DOUBLE) / nullif(amt_n, 0), no_past), 0.0) AS amount_deviation,
  CAST(n_prev = 0 AS INTEGER) AS is_new_supplier FROM h)
"""


_MEDIAN = "(SELECT m FROM mid)"


def history_sql() -> str:
    """The views up to ``features``, for queries over prepared invoices."""
    return _history_sql(_MEDIAN).rstrip()


_FEATURES = f"""SELECT row_no, supplier_key, {", ".join(
    f"round({f}, 6) AS {f}" if f in ("prev_incident_rate", "prev_mean_amount", "prev_max_amount", "amount_deviation") else f
    for f in S.HISTORY_FEATURES)} FROM features"""


def _history(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = enrich.derive_columns(fx.invoices(spark, sf_dir))
    return history.supplier_history(rows, **options)


def _rounded(df: DataFrame) -> DataFrame:
    doubles = ("prev_incident_rate", "prev_mean_amount", "prev_max_amount", "amount_deviation")
    return df.select("row_no", "supplier_key", *S.HISTORY_FEATURES).withColumns({c: F.round(c, 6) for c in doubles})


@query("supplier_history", _history_sql(_MEDIAN) + _FEATURES, ("derived",))
def supplier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_history(spark, sf_dir))


@query("supplier_history_hot_keys", _history_sql(_MEDIAN) + _FEATURES, ("derived",))
def supplier_history_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features with every larger supplier treated as hot: cut into slices, then merged."""
    return _rounded(_history(spark, sf_dir, hot_rows=8))


@query(
    "supplier_history_past_fill",
    _history_sql("coalesce(past.past_mean, 0.0)") + _FEATURES,
    ("derived",),
)
def supplier_history_past_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_history(spark, sf_dir, fill="past_mean"))


@query(
    "leakage_report",
    _history_sql(_MEDIAN)
    + """SELECT count(*) AS rows, CAST(sum(incident) AS DOUBLE) / count(incident) AS global_rate,
  CAST(sum(is_new_supplier) AS BIGINT) AS new_supplier_rows FROM features""",
    ("derived",),
)
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.leakage_report(_history(spark, sf_dir))


@query(
    "prepared_invoices",
    _history_sql(_MEDIAN)
    + f"""SELECT d.row_no, d.key_status, d.domicile, d.irregular, d.registry_found, {", ".join(f"d.{f}" for f in S.LIST_FLAGS)},
  d.term_days, d.incident, f.prev_count, f.incidents_90d, round(f.prev_incident_rate, 6) AS prev_incident_rate,
  round(f.amount_deviation, 6) AS amount_deviation
FROM derived d JOIN features f ON d.row_no = f.row_no""",
    ("derived",),
)
def prepared_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation: derived columns, history, registry and lists."""
    return fx.prepared(spark, sf_dir).select(
        "row_no", "key_status", "domicile", "irregular", "registry_found", *S.LIST_FLAGS, "term_days", "incident",
        "prev_count", "incidents_90d", F.round("prev_incident_rate", 6).alias("prev_incident_rate"),
        F.round("amount_deviation", 6).alias("amount_deviation"),
    )
