from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.sources import importing, invoices, links


def test_key_column_is_found_by_content(spark):
    df = spark.createDataFrame(
        [("20123456789", "COMERCIAL UNO SAC"), ("20987654321", "SERVICIOS DOS")], ["Proveedor", "Ruc Proveedor"]
    )
    found = importing.detect_columns(df)
    assert (found["supplier_key"], found["supplier_name"]) == ("Proveedor", "Ruc Proveedor")


def test_headers_are_found_by_alias(spark):
    headers = ["RUC", "Fecha Emision", "Monto Total", "Estado SUNAT", "Estado", "Observación"]
    df = spark.createDataFrame([("20123456789", "01/02/2025", "5", "Aceptada", "x", "y")], headers)
    found = importing.detect_columns(df)
    assert found == {"supplier_key": "RUC", "issued_ts": "Fecha Emision", "amount": "Monto Total", "state": "Estado SUNAT"}


def test_import(spark, tmp_path):
    text = "RUC;Fecha Emisión;Importe;Estado Aceptación\n20-123456789;15/01/2025;1.234,50;aceptado\n20123456789;16/01/2025;99,9;RECHAZADA\nn/a;x;1;raro\n"
    (tmp_path / "in.csv").write_bytes(text.encode("latin-1"))
    source = invoices.read_delimited(spark, str(tmp_path / "in.csv"), encoding="ISO-8859-1")
    report = importing.import_history(source, str(tmp_path / "out"))
    assert (report.rows, report.suppliers) == (2, 1)
    assert sorted(report.states.collect()) == [("Aceptada", 1), ("Rechazada", 1)]
    assert (report.first_day, report.last_day) == (dt.date(2025, 1, 15), dt.date(2025, 1, 16))
    assert report.warnings[0].startswith("1 rows without a valid supplier key") and len(report.warnings) == 6
    rows = {r["invoice_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(rows) == ["IMP-00000000", "IMP-00000001"]
    assert sorted(r["amount"] for r in rows.values()) == [99.9, 1234.5]
    assert all(r["due_ts"] == r["issued_ts"] and r["currency"] == "No especificado" for r in rows.values())
    with pytest.raises(ValueError, match="no column found for issued_ts"):
        importing.convert_history(source, {"supplier_key": "RUC", "amount": "Importe", "state": "x"})


def test_generated_ids_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("o"))
    got = {r["o"]: r["invoice_id"] for r in importing.generate_ids(df.repartition(6), "o").collect()}
    assert got == {i: f"IMP-{i:08d}" for i in range(500)}


def test_content_shares_and_dictionary(spark):
    df = spark.createDataFrame([("20123456789", "abc", None), ("12", None, None)], "k string, supplier_name string, incident int")
    got = {r["column_name"]: (r["key_share"], r["text_share"]) for r in importing.content_shares(df).collect()}
    assert got == {"k": (0.5, 0.0), "supplier_name": (0.0, 1.0), "incident": (0.0, 0.0)}
    entries = {r["column_name"]: r for r in importing.data_dictionary(df, ["k"]).collect()}
    assert entries["supplier_name"]["example"] == "" and entries["k"]["in_model"] and entries["incident"]["exclusion"] == "target"


PAGES = [
    ("https://site.test/a/b.html?x=1", '<a class="c" href="../files/other.ZIP">x</a> <A HREF=\'//cdn.test/padron_1.zip\'>y</A> <a href="/p.html">n</a>'),
    ("https://site.test/a/", '<p>get "data/padron_reducido.zip" now</p>'),
    ("https://site.test", '<a href="./x.zip">a</a><a href="q.zip?v=2">b</a>'),
    ("https://site.test/n", "<p>nothing</p>"),
]


def test_links(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES)], "page_id bigint, url string, html string")
    ranked = [(r["page_id"], r["link_rank"], r["link"]) for r in links.rank_download_links(pages).orderBy("page_id", "link_rank").collect()]
    assert ranked == [
        (0, 1, "https://cdn.test/padron_1.zip"),
        (0, 2, "https://site.test/files/other.ZIP"),
        (1, 1, "https://site.test/a/data/padron_reducido.zip"),
        (2, 1, "https://site.test/x.zip"),
        (2, 2, "https://site.test/q.zip?v=2"),
    ]
    best = links.best_download_link(pages).orderBy("page_id").collect()
    assert [r["preferred"] for r in best] == [True, True, False]


def test_export_is_typed_and_anonymous(spark):
    df = spark.createDataFrame(
        [("20123456789", "NAME", "CLIENT", "31/12/2024", "10.5", " Factura ", "1", "2024.0", "n")],
        ["Proveedor", "Ruc Proveedor", "Cliente", "Fecha_Emision", "Importe_Total", "Tipo_Comprobante", "Flag_Aceptada", "Año", "Extra"],
    )
    got = invoices.anonymize_history(df)
    assert got.columns == ["supplier_key", "issued_ts", "amount", "doc_type", "flag_accepted", "year", "Extra"]
    assert got.first() == ("20123456789", dt.datetime(2024, 12, 31), 10.5, "Factura", 1, 2024, "n")


def test_checked_write_keeps_what_it_refuses(spark, tmp_path):
    from ledgerscope.sources import checked

    rows = [("20100000001", "01/02/2024", "1"), ("x", "31/31/2024", "one"), (None, None, None), ("20100000002", " ", "2.5")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "key string, day string, n string, reasons string")
    rules = {"key": checked.invalid_key("key"), "day": checked.unreadable_date("day"), "n": checked.unreadable_int("n")}
    found = checked.write_checked(df, rules, str(tmp_path / "a"))
    assert (found.rows, found.rejected_rows, found.broken) == (4, 3, {"key": 2, "day": 1, "n": 2})
    assert [tuple(r) for r in found.good.collect()] == [("20100000001", "01/02/2024", "1")]
    assert {(r["key"], tuple(r["reasons"])) for r in found.rejected.collect()} == {
        ("x", ("key", "day", "n")), (None, ("key",)), ("20100000002", ("n",)),
    }
    none = checked.write_checked(df.limit(0), rules, str(tmp_path / "b"))
    assert (none.rows, none.rejected_rows, none.good.count(), none.rejected.count()) == (0, 0, 0, 0)
