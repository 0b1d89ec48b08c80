"""Queries over sources, imports, links and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import schema as S
from ledgerscope.operators import enrich, learn
from ledgerscope.plans import fixtures as fx
from ledgerscope.plans.cleaning_queries import summary_sql
from ledgerscope.plans.registry import query
from ledgerscope.sources import by_time, checked, importing, invoices, links, registries
from ledgerscope.sources.workspace import workspace
from ledgerscope.streaming import incremental, quantiles


# --------------------------------------------------------------------------- exports and imports
def _export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices as the untidy text export that a user would import."""
    return fx.invoices(spark, sf_dir).selectExpr(
        "row_no",
        "invoice_id AS ID_Comprobante",
        "raw_key AS Proveedor",
        "supplier_name AS `Ruc Proveedor`",
        "'Cliente ' || doc_type AS Cliente",
        "' ' || doc_type || ' ' AS Tipo_Comprobante",
        "date_format(created_ts, 'dd/MM/yyyy') AS Fecha_Creacion",
        "date_format(issued_ts, 'dd/MM/yyyy') AS Fecha_Emision",
        "date_format(due_ts, 'dd/MM/yyyy') AS Fecha_Vencimiento",
        "currency AS Moneda",
        "CASE WHEN row_no % 13 = 0 THEN 'sin dato' ELSE format_string('%.2f', amount) END AS Importe_Total",
        "state AS Estado_Aceptacion",
        "CASE WHEN row_no % 7 = 0 THEN 'x' ELSE CAST(row_no % 2 AS STRING) END AS Flag_Aceptada",
        "CAST(year(issued_ts) AS STRING) AS `Año`",
        "date_format(issued_ts, 'yyyyMM') AS `Orden_Año_Mes`",
    )


@query(
    "typed_history",
    """SELECT row_no, invoice_id, supplier_key, doc_type, created_ts, issued_ts, due_ts, currency,
  CASE WHEN row_no % 13 <> 0 THEN amount END AS amount, state,
  CAST(CASE WHEN row_no % 7 <> 0 THEN row_no % 2 END AS TINYINT) AS flag_accepted,
  CAST(year(issued_ts) AS INTEGER) AS year,
  CAST(year(issued_ts) * 100 + month(issued_ts) AS INTEGER) AS year_month_order FROM invoices""",
    ("invoices",),
)
def typed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = invoices.anonymize_history(_export_text(spark, sf_dir))
    return typed.withColumn("row_no", F.col("row_no").cast("bigint"))


@query(
    "column_content_share",
    """SELECT column_name, avg(CAST(length(regexp_replace(v, '[^0-9]', '', 'g')) = 11 AS INTEGER)) AS key_share,
  avg(CAST(regexp_matches(v, '[A-Za-zÁÉÍÓÚÑ]{3,}') AS INTEGER)) AS text_share
FROM (SELECT 'supplier_key' AS column_name, supplier_key AS v FROM invoices
      UNION ALL SELECT 'raw_key', raw_key FROM invoices UNION ALL SELECT 'supplier_name', trim(supplier_name) FROM invoices
      UNION ALL SELECT 'doc_type', doc_type FROM invoices UNION ALL SELECT 'invoice_id', invoice_id FROM invoices
      UNION ALL SELECT 'currency', currency FROM invoices UNION ALL SELECT 'state', state FROM invoices
      UNION ALL SELECT 'row_no', CAST(row_no AS VARCHAR) FROM invoices) GROUP BY column_name""",
    ("invoices",),
)
def column_content_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ["supplier_key", "raw_key", "supplier_name", "doc_type", "invoice_id", "currency", "state", "row_no"]
    return importing.content_shares(fx.invoices(spark, sf_dir), text)


def _import_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a delimited file with swapped supplier headers and read it back."""
    rows = fx.invoices(spark, sf_dir).selectExpr(
        "row_no",
        "supplier_key AS Proveedor",
        "'Comercial ' || doc_type || ' S.A.' AS `Ruc Proveedor`",
        "date_format(issued_ts, 'dd/MM/yyyy') AS `Fecha de Emisión`",
        "format_string('%.2f', amount) AS Monto",
        "state AS `Estado SUNAT`",
    )
    path = workspace(spark, "import")
    rows.write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return invoices.read_delimited(spark, path, sep=";", encoding="ISO-8859-1")


@query(
    "delimited_history",
    """SELECT CAST(row_no AS VARCHAR) AS row_no, supplier_key AS proveedor, strftime(issued_ts, '%d/%m/%Y') AS issued,
  state FROM invoices""",
    ("invoices",),
)
def delimited_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import_file(spark, sf_dir)
    return rows.select(
        "row_no", F.col("Proveedor").alias("proveedor"), F.col("`Fecha de Emisión`").alias("issued"),
        F.col("`Estado SUNAT`").alias("state"),
    )


@query(
    "detected_columns",
    """SELECT unnest(['supplier_key', 'supplier_name', 'issued_ts', 'amount', 'state']) AS column_name,
  unnest(['Proveedor', 'Ruc Proveedor', 'Fecha de Emisión', 'Monto', 'Estado SUNAT']) AS header
FROM (SELECT count(*) FROM orders)""",
)
def detected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importing.detect_columns(_import_file(spark, sf_dir))
    return spark.createDataFrame(list(found.items()), "column_name string, header string")


@query(
    "imported_history",
    """SELECT CAST(row_number() OVER (ORDER BY row_no) - 1 AS BIGINT) AS id_number, supplier_key,
  'Comercial ' || doc_type || ' S.A.' AS supplier_name, issued_ts, issued_ts AS due_ts, amount, state,
  'No especificado' AS doc_type, 'No especificado' AS currency
FROM invoices WHERE supplier_key IS NOT NULL""",
    ("invoices",),
)
def imported_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _import_file(spark, sf_dir).withColumn("row_no", F.col("row_no").cast("bigint"))
    mapping = importing.detect_columns(rows.drop("row_no"))
    result = importing.convert_history(rows, mapping, "row_no")
    number = F.substring("invoice_id", 5, 20).cast("bigint")
    return result.select(
        number.alias("id_number"), "supplier_key", "supplier_name", "issued_ts", "due_ts", "amount", "state", "doc_type",
        "currency",
    )


_DICTIONARY = {
    "row_no": "bigint", "invoice_id": "string", "raw_key": "string", "supplier_name": "string", "doc_type": "string",
    "currency": "string", "created_ts": "timestamp", "issued_ts": "timestamp", "due_ts": "timestamp", "paid_ts": "timestamp",
    "amount": "double", "state": "string", "supplier_key": "string",
}


def _dictionary_sql(column: str, kind: str) -> str:
    # Examples are the least texts; those of doubles are written differently by the two engines, so they are left out here.
    text = f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp" else f"CAST({column} AS VARCHAR)"
    empty = column in S.PRIVATE_COLUMNS or kind == "double"
    example = "''" if empty else f"(SELECT coalesce(min(replace({text}, '|', '/')), '') FROM invoices)"
    reason = "known only afterwards" if column in S.LEAKING_COLUMNS else ""
    used = str(column in S.FULL_FEATURES).lower()
    return (
        f"SELECT '{column}' AS column_name, '{kind}' AS data_type, {example} AS example, {used} AS in_model, "
        f"'{reason}' AS exclusion"
    )


@query("data_dictionary", " UNION ALL ".join(_dictionary_sql(*c) for c in _DICTIONARY.items()), ("invoices",))
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = importing.data_dictionary(fx.invoices(spark, sf_dir))
    return table.withColumn("example", F.when(F.col("data_type") == "double", "").otherwise(F.col("example")))


_TYPED = T.StructType(
    [
        T.StructField("row_no", T.LongType()), T.StructField("supplier_key", T.StringType()), T.StructField("state", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("issued_ts", T.TimestampType()),
    ]
)


@query("written_history", "SELECT row_no, supplier_key, state, amount, issued_ts FROM invoices", ("invoices",))
def written_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the history, a folder per state, and read back the columns that are asked for."""
    path, rows = workspace(spark, "written"), fx.invoices(spark, sf_dir)
    invoices.write_dataset(rows, path, partition_by=["state"])
    return invoices.read_invoices(spark, path, _TYPED.names, _TYPED)


@query(
    "recent_invoices",
    """SELECT row_no, supplier_key, state, amount, issued_ts FROM invoices
WHERE issued_ts >= date_trunc('month', (SELECT max(issued_ts) FROM invoices)) - INTERVAL 2 MONTH""",
    ("invoices",),
)
def recent_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three months of a history in files by time: only their files are opened, the last month is known without any."""
    path = workspace(spark, "by-time")
    by_time.write_by_time(fx.invoices(spark, sf_dir).select(*_TYPED.names), path, files=16)
    latest = by_time.time_files(spark, path).agg(F.add_months(F.trunc(F.max("last"), "month"), -2).cast("timestamp")).first()[0]
    return by_time.read_between(spark, path, latest)


@query(
    "import_report",
    """SELECT count(*) FILTER (WHERE supplier_key IS NOT NULL) AS rows, count(DISTINCT supplier_key) AS suppliers,
  CAST(min(issued_ts) FILTER (WHERE supplier_key IS NOT NULL) AS DATE) AS first_day,
  CAST(max(issued_ts) FILTER (WHERE supplier_key IS NOT NULL) AS DATE) AS last_day,
  count(*) FILTER (WHERE supplier_key IS NOT NULL AND state = 'Aceptada') AS accepted,
  count(*) FILTER (WHERE supplier_key IS NULL) || ' rows without a valid supplier key, left out' AS no_key,
  count(*) FILTER (WHERE supplier_key IS NOT NULL AND issued_ts IS NULL) || ' rows with an unreadable issue date' AS no_date
FROM invoices""",
    ("invoices",),
)
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, convert, write and report on a delimited file; the report as one row."""
    source = _import_file(spark, sf_dir).withColumn("row_no", F.col("row_no").cast("bigint"))
    report = importing.import_history(source, workspace(spark, "imported"), "row_no")
    said = {w.split(" ", 1)[1]: w for w in report.warnings if w[0].isdigit()}
    accepted = report.states.where(F.col("state") == S.ACCEPTED).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    row = (
        report.rows, report.suppliers, report.first_day, report.last_day, accepted,
        said.get("rows without a valid supplier key, left out"), said.get("rows with an unreadable issue date"),
    )
    schema = "rows bigint, suppliers bigint, first_day date, last_day date, accepted bigint, no_key string, no_date string"
    return spark.createDataFrame([row], schema)


def _checks() -> dict[str, Column]:
    return {
        "supplier key": checked.invalid_key("Proveedor"),
        "issue date": checked.missing_value("Fecha_Emision") | checked.unreadable_date("Fecha_Emision"),
        "amount": checked.unreadable_amount("Importe_Total"),
        "flag": checked.unreadable_int("Flag_Aceptada"),
    }


_BROKEN_SQL = """broken AS (SELECT row_no, list_filter([CASE WHEN supplier_key IS NULL THEN 'supplier key' END,
  CASE WHEN issued_ts IS NULL THEN 'issue date' END, CASE WHEN row_no % 13 = 0 OR amount IS NULL THEN 'amount' END,
  CASE WHEN row_no % 7 = 0 THEN 'flag' END], lambda r: r IS NOT NULL) AS reasons FROM invoices)"""


@query(
    "rejected_rows",
    f"WITH {_BROKEN_SQL} SELECT row_no, array_to_string(reasons, ', ') AS reasons FROM broken WHERE len(reasons) > 0",
    ("invoices",),
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an untidy export that a checked write refuses, with all reasons."""
    found = checked.write_checked(_export_text(spark, sf_dir), _checks(), workspace(spark, "checked"))
    return found.rejected.select("row_no", F.array_join("reasons", ", ").alias("reasons"))


@query(
    "rejected_counts",
    f"""WITH {_BROKEN_SQL}, each_one AS (SELECT unnest(reasons) AS rule FROM broken)
SELECT rule, count(*) AS n FROM each_one GROUP BY rule UNION ALL SELECT 'all rows', count(*) FROM broken
UNION ALL SELECT 'rejected rows', count(*) FROM broken WHERE len(reasons) > 0""",
    ("invoices",),
)
def rejected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a checked write."""
    found = checked.write_checked(_export_text(spark, sf_dir), _checks(), workspace(spark, "checked"))
    counts = [(rule, n) for rule, n in found.broken.items() if n]
    counts += [("all rows", found.rows), ("rejected rows", found.rejected_rows)]
    return spark.createDataFrame(counts, "rule string, n bigint")


@query(
    "filled_categories",
    """SELECT row_no, coalesce(doc_type, 'NA') AS doc_type, coalesce(currency, 'NA') AS currency FROM invoices""",
    ("invoices",),
)
def filled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.fill_missing_categories(fx.invoices(spark, sf_dir).select("row_no", "doc_type", "currency"))


@query(
    "membership_flags_file",
    """SELECT supplier_key, is_withholding, is_good_taxpayer, 0 AS is_fuel_perception, 0 AS is_domestic_perception FROM flags""",
    ("flags",),
)
def membership_flags_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two of the flags with a second, differing row per key behind the first; the first one counts."""
    flags = fx.flags(spark, sf_dir).select("supplier_key", "is_withholding", "is_good_taxpayer")
    path = workspace(spark, "flags")
    twice = F.array(
        F.struct("supplier_key", "is_withholding", "is_good_taxpayer"),
        F.struct(
            "supplier_key", (1 - F.col("is_withholding")).alias("is_withholding"), (1 - F.col("is_good_taxpayer")).alias("is_good_taxpayer")
        ),
    )
    flags.select(F.inline(twice)).write.parquet(path)
    return registries.read_membership_flags(spark, path)


# --------------------------------------------------------------------------- registry files
@query(
    "registry_file",
    "SELECT supplier_key, legal_name, key_status, domicile, address, irregular FROM registry",
    ("registry",),
)
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the registry as a text file with some damaged lines, read it, keep the wanted suppliers."""
    raw = fx.registry_raw(spark, sf_dir)
    fields = [F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("-") for c in S.REGISTRY_FILE_COLUMNS]
    # The order of the lines decides which of two entries wins, so it is written out in order.
    lines = raw.repartitionByRange("line_no").sortWithinPartitions("line_no")
    damaged = F.when(F.col("supplier_key").isNotNull(), F.concat_ws("|", *fields, F.lit("")))
    broken = F.concat_ws("|", *[F.lit("x")] * (len(fields) + 3))
    path = workspace(spark, "registry")
    lines.select(F.explode(F.array(damaged, F.when(F.col("line_no") % 50 == 0, broken))).alias("value")).where(
        F.col("value").isNotNull()
    ).write.text(path)
    registry = registries.read_registry(spark, path, encoding="UTF-8")
    keys, few = fx.supplier_keys(spark, sf_dir)
    found = enrich.filter_registry(registry, keys, small=few)
    return found.select("supplier_key", "legal_name", "key_status", "domicile", "address", "irregular")


@query(
    "membership_file",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS supplier_key, 'La "' || c_name || '" S.A.' AS name,
  '01/02/2020' AS since FROM customer WHERE c_acctbal > 7000""",
)
def membership_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a membership list with carriage returns and quotes, read it back."""
    members = fx.lists(spark, sf_dir)["is_withholding"]
    line = F.concat_ws(
        "|",
        F.col("c_custkey").cast("string"),
        F.concat(F.lit('"La "'), F.col("c_name"), F.lit('" S.A."')),
        F.lit(" 01/02/2020 "),
        F.lit("RES-1"),
        F.lit(""),
    )
    path = workspace(spark, "members")
    members.select(line).write.option("lineSep", "\r").text(path)
    return registries.read_membership_list(spark, path, encoding="UTF-8")


@query(
    "page_links_ranked",
    r"""
WITH found AS (SELECT page_id, url, list_filter(
    list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1),
      lambda h: regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || trim(h)),
    lambda h: contains(lower(h), '/d')) AS links FROM pages),
positions AS (SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS pos FROM found),
marked AS (SELECT *, contains(lower(link), 'des') OR contains(lower(link), 'die') AS preferred FROM positions)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY preferred DESC, pos) AS INTEGER) AS link_rank,
  link, preferred FROM marked""",
)
def page_links_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    return links.rank_download_links(pages, contains="/d", preferred=("des", "die"))


# --------------------------------------------------------------------------- streams
_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query("incremental_supplier_summary", summary_sql("SELECT * FROM finished"), ("invoices",))
def incremental_supplier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    files, path = workspace(spark, "orders-stream"), workspace(spark, "summary-stream")
    fx.table(spark, sf_dir, "orders").repartition(3).write.parquet(files)  # three files, so three batches to merge
    stream = invoices.stream_invoices(spark, files, _ORDERS, file_glob="*.parquet", files_per_batch=1)
    incremental.run_summary_stream(fx.invoices_from_orders(stream), path)
    return incremental.merged_summary(spark, path)


@query(
    "incremental_upsert",
    """
WITH v AS (SELECT lpad(raw_id, 11, '0') AS supplier_key, max(line_no) AS last, min(line_no) AS first FROM registry_raw
  GROUP BY raw_id),
s AS (SELECT v.supplier_key, a.key_status = b.key_status AND v.first < v.last AS same, v.first < v.last AS twice
  FROM v JOIN registry_raw a ON a.line_no = v.last JOIN registry_raw b ON b.line_no = v.first)
SELECT count(*) AS read, count(*) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS unchanged,
  CAST(0 AS BIGINT) AS version FROM s
UNION ALL
SELECT count(*) FILTER (WHERE twice), CAST(0 AS BIGINT), count(*) FILTER (WHERE twice AND NOT same),
  count(*) FILTER (WHERE twice AND same), CAST(1 AS BIGINT) FROM s""",
    ("registry_raw",),
)
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the first line of every supplier, then the second lines, as two batches of a stream."""
    raw = fx.registry_raw(spark, sf_dir)
    files = workspace(spark, "upsert-input")
    second = F.col("line_no") >= 1_000_000_000
    path = workspace(spark, "upsert-stream")
    for part in (raw.where(~second), raw.where(second)):  # what is there when the stream starts is one batch
        part.write.mode("append").parquet(files)
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1_000_000).parquet(files)
        incremental.run_upsert_stream(stream.withColumn("irregular", F.lit("0")), path, "line_no")
    return incremental.upsert_history(spark, path)


@query(
    "incremental_quantiles",
    "SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share, (SELECT count(amount) FROM invoices) AS rows, true AS close_enough",
    ("invoices",),
)
def incremental_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the amounts from the sketches of three batches of a stream, held against the true ranks of all rows."""
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    rows = fx.invoices(spark, sf_dir).select("row_no", F.col("amount").cast("double").alias("amount"))
    files, path = workspace(spark, "amounts"), workspace(spark, "sketches")
    for part in range(3):
        rows.where(F.pmod("row_no", F.lit(3)) == part).write.mode("append").parquet(files)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(files)
        quantiles.run_quantile_stream(stream, path, ["amount"])
    merged = quantiles.merged_sketches(spark, path)
    found = {r["share"]: r["value"] for r in quantiles.sketch_quantiles(merged, shares).collect()}  # one row per share
    amount, n = F.col("amount"), F.count("amount")
    entries = [
        F.struct(
            F.lit(q).alias("share"),
            n.alias("rows"),
            # Equal amounts share a span of ranks; the sketch may name any of them.
            (
                (F.count_if(amount < v) <= (q + quantiles.RANK_ERROR) * n) & (F.count_if(amount <= v) >= (q - quantiles.RANK_ERROR) * n)
            ).alias("close_enough"),
        )
        for q, v in found.items()
    ]
    return rows.agg(F.array(*entries).alias("e")).select(F.inline("e"))
