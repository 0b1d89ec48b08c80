from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import risk, temporal, text


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


def test_keys(spark):
    raw = ["20-12345678-9", " 123 ", None, "201234567890", "", "abc", "20123456789.0"]
    assert apply(spark, text.normalize_key, raw) == ["20123456789", "00000000123", None, None, None, None, None]
    assert apply(spark, text.normalize_key, [42], "bigint") == ["00000000042"]
    assert apply(spark, text.is_valid_key, [" 20123456789 ", "123", None]) == [True, False, False]


def test_amounts(spark):
    raw = ["1.234,56", "1,234.56", "S/ 99", "-5,5", "n/a", None, "1.234", "12,345", "1-2"]
    assert apply(spark, text.parse_amount, raw) == [1234.56, 1234.56, 99.0, -5.5, None, None, 1.234, 12345.0, None]


def test_states(spark):
    raw = ["ACEPTADO", "observada", None, "Recházada por sistema", "Aceptada con observaciones", "otro", " X "]
    raw += ["Aceptado con observaciones", "PENDIENTE-BORRADOR"]
    assert apply(spark, text.normalize_state, raw) == [
        "Aceptada", "Observada", "Pendiente / Borrador", "Rechazada", "Observada", "otro", "X", "Aceptada",
        "Pendiente / Borrador",
    ]


def test_text(spark):
    assert apply(spark, text.ascii_text, [" Ñandú--Café ", "Straße 5", "ABC", "ﾊ", None]) == ["nandu cafe", "strae 5", "abc", "", None]
    assert text.plain_ascii(" Ñandú--Café ") == "nandu cafe"
    assert apply(spark, text.upper_name, [" Razón  Social* "]) == ["RAZON_SOCIAL"]
    assert apply(spark, text.clean_upper, [" no \t habido ", None]) == ["NO HABIDO", ""]
    assert apply(spark, text.ellipsize, ["x" * 28, "y" * 29]) == ["x" * 28, "y" * 27 + "…"]
    assert apply(spark, text.mask, ["name", "", None]) == ["***", "", None]


def test_address_and_names(spark):
    df = spark.createDataFrame([("AV.", " - ", "12 ", None), (None, None, "-", "")], "a string, b string, c string, d string")
    columns = [F.col(c) for c in "abcd"]
    assert [r[0] for r in df.select(text.join_address(*columns)).collect()] == ["AV. 12", ""]
    names = spark.createDataFrame([("A", "B"), (" ", " B "), (None, None)], "a string, b string")
    assert [r[0] for r in names.select(text.best_name(F.col("a"), F.col("b"))).collect()] == ["A", "B", ""]


def test_dates(spark):
    day = dt.datetime
    parsed = apply(spark, temporal.parse_day_first, ["2025-01-02", "03/02/2025", "3.2.2025", "2025-01-02 10:30", "?", None])
    assert parsed == [day(2025, 1, 2), day(2025, 2, 3), day(2025, 2, 3), day(2025, 1, 2, 10, 30), None, None]
    us = spark.createDataFrame([("12/31/2024",), ("01/25/2025",), ("02/03/2025",)], "d string")
    assert [r[0] for r in temporal.parse_date_columns(us, ["d"]).collect()] == [
        day(2024, 12, 31), day(2025, 1, 25), day(2025, 2, 3),
    ]
    labels = spark.createDataFrame([(day(2025, 9, 5),), (day(1999, 1, 31),)], "t timestamp")
    assert [r[0] for r in labels.select(text.month_label(F.col("t"))).collect()] == ["Set 25", "Ene 99"]


def test_strict_conversions_fail_on_bad_values(spark):
    assert apply(spark, temporal.strict_int, [" 1 ", "", None]) == [1, None, None]
    for function in (temporal.strict_int, temporal.strict_date):
        with pytest.raises(Exception, match="not a"):
            apply(spark, function, ["bad"])
    df = spark.createDataFrame([("1", "2025-01-01"), ("x", "y"), ("", None)], "n string, d string")
    assert temporal.conversion_rejects(df, dates=["d"], ints=["n"]).first() == (1, 1)


def test_tiers_and_labels(spark):
    assert apply(spark, lambda v: risk.risk_tier(v, 0.3, 0.6), [0.29, 0.3, 0.59, 0.6], "double") == ["Bajo", "Medio", "Medio", "Alto"]
    assert apply(spark, lambda v: risk.prediction_code(v, 0.5), [0.5, 0.49], "double") == [1, 0]
    assert apply(spark, risk.incident_target, ["Aceptada", "Observada", "Rechazada", "Pendiente", None]) == [0, 1, 1, None, None]


def test_reasons(spark):
    rows = [
        ("ACTIVO", "HABIDO", 0, 0, 0.1, -1.0),
        ("BAJA", "NO HABIDO", 1, 1, 0.5, 3.0),
        (None, None, None, None, 0.2, None),
    ]
    df = spark.createDataFrame(rows, "s string, d string, i int, n int, r double, a double")
    reasons = risk.reasons_text(risk.risk_reasons(*[F.col(c) for c in "sdinra"]))
    assert [r[0] for r in df.select(reasons).collect()] == [
        "Sin factores de riesgo destacados",
        "Estado RUC BAJA; Domicilio NO HABIDO; Situacion tributaria irregular; Proveedor sin historial previo",
        "Historial previo con incidencias",
    ]
