"""Reading and writing invoice histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import schema as S
from ledgerscope.functions.temporal import parse_day_first
from ledgerscope.functions.text import normalize_key


def read_invoices(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType = S.HISTORY_SCHEMA,
) -> DataFrame:
    """Typed Parquet history; only the requested columns are read."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(schema).parquet(*paths)
    return df.select(*columns) if columns else df


def stream_invoices(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.HISTORY_SCHEMA,
    *,
    files_per_batch: int = 1000,
    file_glob: str | None = None,
) -> DataFrame:
    """The same files as a stream of micro-batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(path)


def read_delimited(
    spark: SparkSession, path: str, *, sep: str = ";", encoding: str = "UTF-8", header: bool = True
) -> DataFrame:
    """Delimited text with every column as text.

    Use ``ISO-8859-1`` for Latin-1 files. A UTF-8 byte order mark is dropped from the first header.
    """
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=header, inferSchema=False, mode="PERMISSIVE")
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


# Columns of the original export that are dropped or renamed when it is published.
EXPORT_DROPPED = ("Ruc Proveedor", "Cliente")
EXPORT_RENAMED = {
    "Origen": "origin",
    "ID_Comprobante": "invoice_id",
    "Proveedor": "supplier_key",
    "Tipo_Comprobante": "doc_type",
    "Fecha_Creacion": "created_ts",
    "Fecha_Emision": "issued_ts",
    "Fecha_Vencimiento": "due_ts",
    "Fecha_Pago": "paid_ts",
    "Moneda": "currency",
    "Importe_Total": "amount",
    "Estado": "doc_state",
    "Estado_Grupo": "doc_state_group",
    "Estado_Emision": "issue_state",
    "Estado_Aceptacion": "state",
    "Estado_Pago": "payment_state",
    "Flag_Factura": "flag_invoice",
    "Flag_Emitida": "flag_issued",
    "Flag_Aceptada": "flag_accepted",
    "Flag_Observada": "flag_observed",
    "Flag_Rechazada": "flag_rejected",
    "Flag_Pendiente_Pago": "flag_pending_payment",
    "Año": "year",
    "Trimestre": "quarter_label",
    "Mes_Num": "month_number",
    "Mes": "month_name",
    "Año_Mes": "year_month",
    "Orden_Año_Mes": "year_month_order",
}


def anonymize_history(df: DataFrame) -> DataFrame:
    """Text export to the typed public history: names dropped, columns renamed, values typed.

    In the export the key and the name of the supplier are swapped; the rename puts the key right.
    """
    public = df.drop(*EXPORT_DROPPED).withColumnsRenamed(EXPORT_RENAMED)
    typed = {}
    for field in S.HISTORY_SCHEMA.fields:
        if field.name not in public.columns:
            continue
        value = F.col(field.name)
        if field.name == "supplier_key":
            typed[field.name] = normalize_key(value)
        elif isinstance(field.dataType, T.TimestampType):
            typed[field.name] = parse_day_first(value)
        elif isinstance(field.dataType, T.StringType):
            typed[field.name] = F.trim(value)
        else:
            typed[field.name] = F.trim(value).try_cast("double").try_cast(field.dataType)
    unknown = {c: F.trim(c) for c in public.columns if c not in typed}
    return public.withColumns(typed | unknown)


def write_dataset(
    df: DataFrame,
    path: str,
    *,
    format: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    files: int | None = None,
) -> None:
    """Write a dataset: Parquet (zstd) by default, or CSV with header, or JSON lines."""
    if files is not None:
        df = df.repartition(files)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif format == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format: {format}")
