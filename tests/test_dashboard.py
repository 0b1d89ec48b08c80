from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerscope.operators import dashboard
from ledgerscope.plans.pipeline import finish_predictions, risk_cuts

SCHEMA = (
    "row_no int, invoice_id string, supplier_key string, supplier_name string, legal_name string, doc_type string, "
    "tier string, code int, probability double, amount double, issued_ts timestamp, reasons string, is_withholding int, "
    "is_good_taxpayer int"
)
T = dt.datetime
ROWS = [
    (1, "F1", "10", "Uno SAC", None, "Factura", "Alto", 1, 0.9, 100.0, T(2025, 1, 5), "Estado RUC BAJA; Domicilio NO HALLADO", 1, 0),
    (2, "F2", "20", " ", "Dos (SUR)", "Factura", "Alto", 1, 0.8, 300.0, T(2025, 2, 5), "Estado RUC SUSPENSION", 0, 0),
    (3, "B1", "10", None, None, "Boleta", "Bajo", 0, 0.1, -5.0, T(2025, 2, 9), "Sin factores de riesgo destacados", None, 0),
    (4, "B2", None, None, None, "Boleta", "Alto", 0, 0.4, None, None, "Sin factores de riesgo destacados", 0, 0),
]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["row_no"] for r in df.collect())


def test_headline(spark):
    row = dashboard.kpis(frame(spark)).first()
    assert (row["pending"], row["high_risk"], row["high_risk_pct"], row["flagged"]) == (4, 3, 75.0, 2)
    assert dashboard.kpis(frame(spark).limit(0)).first()["high_risk_pct"] == 0.0
    assert [(r["tier"], r["n"]) for r in dashboard.tier_counts(frame(spark)).collect()] == [("Bajo", 1), ("Medio", 0), ("Alto", 3)]


def test_reasons_and_suppliers(spark):
    assert dashboard.top_risk_factors(frame(spark)).collect() == [("Estado RUC irregular", 2), ("Domicilio irregular", 1)]
    top = dashboard.top_risk_suppliers(frame(spark)).collect()
    assert [(r["supplier_key"], r["high_risk"], r["name"]) for r in top] == [("10", 1, "Uno SAC"), ("20", 1, "Dos (SUR)")]
    assert dashboard.has_names(frame(spark)).first()[0] is True
    assert dashboard.mask_private(frame(spark)).where("supplier_name = '***'").count() == 2  # a blank is not empty text


def test_months(spark):
    cells = dashboard.risk_heatmap(frame(spark), 1).collect()
    assert {(r["doc_type"], r["month_label"], r["n"]) for r in cells} == {("Factura", "Feb 25", 1), ("Boleta", "Feb 25", 1)}
    wide = dashboard.risk_heatmap_wide(frame(spark))
    assert wide.columns == ["doc_type", "Ene 25", "Feb 25"] and wide.first()["doc_type"] == "Factura"
    smooth = dashboard.monthly_smooth(dashboard.risk_by_month(frame(spark))).orderBy("month").collect()
    assert [r["is_peak"] for r in smooth] == [True, False] and abs(smooth[0]["smoothed"] - 0.675) < 1e-12


def test_filters(spark):
    df = frame(spark)
    assert ids(dashboard.filter_predictions(df)) == [1, 2, 3, 4]
    assert ids(dashboard.filter_predictions(df, tier="Alto", doc_type="Factura")) == [1, 2]
    assert ids(dashboard.filter_predictions(df, factor="Estado RUC irregular")) == [1, 2]
    assert ids(dashboard.filter_predictions(df, text=" (sur) ")) == [2]  # literal, any case
    assert ids(dashboard.filter_predictions(df, text=".*")) == []
    assert ids(dashboard.filter_predictions(df, supplier_key="10", text="b1")) == [3]
    assert [r["row_no"] for r in dashboard.priority_queue(df, 2).collect()] == [1, 2]
    assert [r["best_name"] for r in dashboard.export_rows(df).collect()] == ["Uno SAC", "Dos (SUR)", "", ""]


def test_lists_and_amounts(spark):
    labels = {"is_withholding": "withholding", "is_good_taxpayer": "good", "missing": "missing"}
    table = dashboard.membership_risk(frame(spark), labels).collect()
    assert [(r["list"], r["inside_pct"], r["invoices"]) for r in table] == [("withholding", 100.0, 1)]
    assert abs(table[0]["outside_pct"] - 200 / 3) < 1e-9
    assert ids(dashboard.amount_sample(frame(spark))) == [1, 2]
    many = spark.range(500).select(
        F.col("id").alias("row_no"), F.lit(1.0).alias("amount"), F.lit(0.5).alias("probability"), F.lit("Bajo").alias("tier")
    )
    first, again = (ids(dashboard.amount_sample(many.repartition(n), 50)) for n in (1, 5))
    assert first == again and len(first) == 50
    assert ids(dashboard.critical_quadrant(frame(spark), 0.5)) == [2]
    assert dashboard.critical_quadrant(frame(spark).where("amount < 0"), 0.5).count() == 0


def test_finished_predictions(spark):
    rows = [(0.2, "ACTIVO", "HABIDO", 0, 0, 0.0, 0.0), (0.9, "BAJA", "HABIDO", 1, 0, 0.3, 1.0)]
    df = spark.createDataFrame(
        rows, "probability double, key_status string, domicile string, irregular int, is_new_supplier int, prev_incident_rate double, amount_deviation double"
    )
    got = finish_predictions(df, threshold=0.5).collect()
    assert [(r["code"], r["tier"]) for r in got] == [(0, "Bajo"), (1, "Alto")]
    assert got[1]["reason_list"][0] == "Estado RUC BAJA" and got[0]["reasons"] == "Sin factores de riesgo destacados"
    assert risk_cuts(df.limit(0)) == (0.30, 0.60)
