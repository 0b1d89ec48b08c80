from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import enrich, profile, skew, summary
from ledgerscope.sources import bucketed, invoices, registries


def test_enrichment_keeps_rows_and_fills(spark):
    history = spark.createDataFrame([("00000000001", 1.0), ("00000000002", 2.0), (None, 3.0)], "supplier_key string, amount double")
    registry = spark.createDataFrame(
        [("00000000001", "ACTIVO", "HABIDO", 0)], "supplier_key string, key_status string, domicile string, irregular int"
    )
    for rows in (1000, 0):
        joined = enrich.enrich_invoices(history, registry, broadcast_rows=rows)
        got = {r["amount"]: (r["registry_found"], r["key_status"], r["domicile"], r["irregular"]) for r in joined.collect()}
        missing = (0, "NO_ENCONTRADO", "NO_ENCONTRADO", -1)
        assert got == {1.0: (1, "ACTIVO", "HABIDO", 0), 2.0: missing, 3.0: missing}
    assert enrich.enrichment_stats(joined).first() == (3, 1, 2, 1, 1)
    with pytest.raises(ValueError, match="not unique"):
        enrich.enrich_invoices(history, registry.union(registry))


def test_dimension_with_number_keys(spark):
    raw = spark.createDataFrame(
        [(123, "ACTIVO", "HABIDO", "0", 1), (123, "BAJA", "HABIDO", "x", 2), (None, "A", "B", "1", 3)],
        "supplier_key bigint, key_status string, domicile string, irregular string, row int",
    )
    got = enrich.normalize_dimension(raw, "row")
    assert got.columns == [f.name for f in S.REGISTRY_SCHEMA.fields]
    assert got.select("supplier_key", "key_status", "irregular", "address").collect() == [("00000000123", "BAJA", None, None)]
    with pytest.raises(ValueError, match="missing columns domicile"):
        enrich.normalize_dimension(raw.drop("domicile"), "row")


def test_dedup(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(enrich.dedup_by_key(rows, "k", "o").collect()) == [("a", 2, "x"), ("b", 1, None)]
    assert sorted(enrich.dedup_by_key(rows, "k", "o", keep="first").collect()) == [("a", 1, "y"), ("b", 1, None)]


def test_flags(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "supplier_key string")
    lists = {"is_withholding": spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "supplier_key string")}
    flags = enrich.build_flags(wanted, lists)
    assert sorted(flags.collect()) == [("a", 1, 0, 0, 0), ("b", 0, 0, 0, 0)]
    assert enrich.build_flags(wanted, {}).agg(F.sum("is_withholding")).first()[0] == 0
    rows = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "supplier_key string, i int")
    got = enrich.add_membership_flags(rows, flags)
    assert sorted(r["i"] * 10 + r["is_withholding"] for r in got.collect()) == [11, 20, 30]
    assert enrich.add_membership_flags(rows, None).where("is_withholding = 0").count() == 3


UPSERT = "supplier_key string, legal_name string, key_status string, domicile string, location_code string, irregular string, queried_on string, source string, row int"


def test_upsert(spark):
    first = spark.createDataFrame(
        [("1", "One", "ACTIVO", "HABIDO", "15", "0", "2024-01-01", "s", 1), ("2", "Two", "BAJA", " ", "15", "1", "2024-01-01", "s", 1)], UPSERT
    )
    flags = spark.createDataFrame([("00000000001", 1, 0, 0, 0)], "supplier_key string, is_withholding int, is_good_taxpayer int, is_fuel_perception int, is_domestic_perception int")
    source = enrich.prepare_upsert_source(first, flags, "row")
    store = enrich.classify_upsert(source.limit(0), source)
    assert enrich.upsert_stats(store).first() == (2, 2, 0, 0)
    assert enrich.upsert_stats(enrich.classify_upsert(store, source)).first() == (2, 0, 0, 2)  # idempotent
    second = spark.createDataFrame(
        [("1", "One", "ACTIVO", "HABIDO", "15", "0", "2024-01-01", "s", 1), ("2", None, "ACTIVO", None, "15", "1", "2024-01-01", "s", 1), ("3", "Three", None, None, None, None, None, None, 1), ("n/a", "x", None, None, None, None, None, None, 1)], UPSERT
    )
    later = enrich.classify_upsert(store, enrich.prepare_upsert_source(second, None, "row"))
    assert enrich.upsert_stats(later).first() == (3, 1, 1, 1)
    got = {r["supplier_key"]: r for r in later.collect()}
    assert got["00000000001"]["is_withholding"] == 1  # an unknown flag keeps the stored value
    assert got["00000000002"]["legal_name"] is None  # a null field overwrites
    bad = spark.createDataFrame([("1", "One", "A", "B", "1", "zero", "2024-01-01", "s", 1)], UPSERT)
    with pytest.raises(Exception, match="not an integer"):
        enrich.prepare_upsert_source(bad, None, "row").collect()
    assert enrich.prepare_upsert_source(bad, None, "row", strict=False).first()["irregular"] is None


def test_registry_file(spark, tmp_path):
    lines = [
        "RUC|NOMBRE|ESTADO|CONDICION|UBIGEO|TIPO DE VIA|NOMBRE DE VIA|",
        "20000000001|COMPAÑÍA \"UNO|activo| Habido|150101|AV.|LOS  ÁLAMOS|",
        "20000000002|DOS|BAJA|HABIDO|150101|-|-|",
        "20000000003|TOO|MANY|FIELDS|1|2|3|4|5|6|7|8|9|10|11|12|13|14|15|16|",
        "20000000004|SHORT",
        "",
        "20000000001|UNO|ACTIVO|NO HABIDO|150101|JR.|LIMA|",
        "99999999999|NOT WANTED|ACTIVO|HABIDO|1|-|-|",
    ]
    (tmp_path / "padron.txt").write_bytes("\r\n".join(lines).encode("latin-1"))
    registry = registries.read_registry(spark, str(tmp_path))
    assert registry.count() == 5
    wanted = spark.createDataFrame([(f"2000000000{i}",) for i in (1, 2, 3, 4)], "supplier_key string")
    found = {r["supplier_key"]: r for r in enrich.filter_registry(registry, wanted).collect()}
    assert sorted(found) == ["20000000001", "20000000002", "20000000004"]
    assert found["20000000001"]["domicile"] == "NO HABIDO" and found["20000000001"]["address"] == "JR. LIMA"
    assert found["20000000002"]["address"] == "" and found["20000000002"]["irregular"] == 1
    assert found["20000000004"]["key_status"] == ""
    report = enrich.registry_report(wanted, enrich.filter_registry(registry, wanted)).first()
    assert report == (4, 3, 1, 0, 3)
    assert registries.registry_column_names(17)[-2:] == ["column_15", "column_16"]
    first = registry.where("legal_name LIKE '%UNO%'").orderBy("line_no").first()
    assert first["legal_name"] == 'COMPAÑÍA "UNO'


@pytest.mark.parametrize("newline", ["\r", "\n"])
def test_membership_file(spark, tmp_path, newline):
    lines = ["Ruc|Nombre|A partir del|Resolucion|", '20000000001|"ÑANDÚ S.A."|01/01/2020|R1|', "20000000001|AGAIN|02/02/2021|R2|", "123|CORTO|01/01/2020|R3|", "|NOKEY|x|y|", "5|few"]
    (tmp_path / "list.txt").write_bytes(newline.join(lines).encode("latin-1"))
    got = sorted(registries.read_membership_list(spark, str(tmp_path), line_sep=newline).collect())
    assert got == [("00000000123", "CORTO", "01/01/2020"), ("20000000001", "ÑANDÚ S.A.", "01/01/2020")]


def test_membership_flags(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "supplier_key bigint, is_withholding int").coalesce(1).write.parquet(str(tmp_path / "f"))
    got = registries.read_membership_flags(spark, str(tmp_path / "f"))
    assert got.collect() == [("00000000001", 1, 0, 0, 0)]


def test_invoice_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "invoice_id string, amount double")
    for kind in ("parquet", "csv", "json"):
        invoices.write_dataset(rows, str(tmp_path / kind), format=kind, files=1)
    back = invoices.read_invoices(spark, str(tmp_path / "parquet"), ["invoice_id", "amount"])
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    text = invoices.read_delimited(spark, str(tmp_path / "csv"), sep=",")
    assert sorted(text.collect(), key=str) == [("a", "1.5"), ("b", None)]
    with pytest.raises(ValueError, match="unknown format"):
        invoices.write_dataset(rows, str(tmp_path / "x"), format="xlsx")


def test_profile(spark):
    t = dt.datetime
    rows = [(1, "a", "20000000001", t(2024, 1, 1), t(2023, 12, 31), -1.0), (2, "a", None, t(1980, 1, 1), None, 2.0), (3, None, "x", None, None, None), (4, None, "20000000001", None, None, 3.0)]
    df = spark.createDataFrame(rows, "row_no int, invoice_id string, raw_key string, issued_ts timestamp, due_ts timestamp, amount double")
    assert profile.key_quality(df).first() == (4, 2, 2, 1)
    issues = {r["rule"]: (r["rows"], r["examples"]) for r in profile.quality_issues(df).collect()}
    assert issues == {"negative_amount": (1, "a"), "due_before_issue": (1, "a"), "date_out_of_range": (1, "a")}
    assert profile.duplicate_ids(df, key="raw_key").first() == (0, 0, 4, 1)
    stats = profile.describe_numeric(df, ["amount"]).first()
    assert (stats["n"], stats["min"], stats["q50"], stats["max"]) == (3, -1.0, 2.0, 3.0)
    assert {r["column_name"]: r["nulls"] for r in profile.null_counts(df).collect()}["issued_ts"] == 2
    assert profile.column_types(df).count() == 6
    raw = df.withColumn("amount_text", F.lit("x"))
    assert {r["rule"]: r["rows"] for r in profile.quality_issues(raw, raw_amount="amount_text").collect()}["amount_unreadable"] == 1


def test_summary_of_suppliers_without_outcome(spark):
    rows = [("a", "Pendiente", None), ("a", None, 2.0), ("b", "Observada", 4.0), (None, "Aceptada", 1.0)]
    df = spark.createDataFrame(rows, "raw_key string, state string, amount double").selectExpr(
        "translate(raw_key, 'ab', '12') AS raw_key", "state", "amount", "CAST(NULL AS TIMESTAMP) AS issued_ts"
    )
    table = summary.by_risk(summary.supplier_summary(summary.clean_history(df))).collect()
    assert [(r["supplier_key"][-1], r["incident_rate"], r["mean_amount"]) for r in table] == [("2", 1.0, 4.0), ("1", None, 2.0)]
    halves = [summary.partial_summary(summary.clean_history(df.where(c))) for c in ("amount > 3", "amount <= 3 OR amount IS NULL")]
    merged = summary.finish_summary(summary.merge_partials(halves[0].unionByName(halves[1])))
    assert sorted(merged.collect(), key=str) == sorted(table, key=str)


def _both(spark):
    history = spark.createDataFrame(
        [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "row_no long, supplier_key string"
    )
    registry = spark.createDataFrame(
        [("hot", "ACTIVO", "HABIDO", 0), ("k0", "BAJA", "HABIDO", 1), (None, "X", "X", 1)],
        "supplier_key string, key_status string, domicile string, irregular int",
    )
    flags = spark.createDataFrame(
        [("hot", 1, 0, 0, 1), ("k6", 0, 1, 0, 0)], ["supplier_key", *S.LIST_FLAGS]
    )
    return history, registry, flags


def test_one_join_for_both_dimensions(spark):
    history, registry, flags = _both(spark)
    want = enrich.add_membership_flags(enrich.enrich_invoices(history, registry), flags)
    for options in ({}, {"broadcast_rows": 0, "hot_rows": 50}):
        got = enrich.enrich_with_flags(history, registry, flags, **options)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    without = enrich.enrich_with_flags(history, registry, None)
    assert without.where("is_withholding = 0").count() == 300


def test_bucketed_join_moves_no_row(spark):
    history, registry, flags = _both(spark)
    facts = bucketed.bucketed_facts(history, "facts", "supplier_key", "row_no", buckets=8, parts=4)
    dim = bucketed.bucketed_dimension(enrich.merged_dimension(registry, flags), "dim", "supplier_key", buckets=8, parts=4)
    joined = bucketed.bucketed_join(facts, dim, "supplier_key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = enrich.add_membership_flags(enrich.enrich_invoices(history, registry), flags)
    got = enrich.fill_dimension(joined).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    per_bucket = facts.groupBy("_part").count().collect()
    assert len(per_bucket) == 4 and max(r["count"] for r in per_bucket) < 150


def test_broadcasts_are_sized_by_bytes(spark):
    wide = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1_000_000))
    assert skew.has_at_most(wide.select("id"), 1000) and not skew.has_at_most(wide, 1000)
    assert not skew.has_at_most(wide.select("id"), 99) and not skew.has_at_most(wide.select("id"), 0)
