"""Schemas, domain values and required-column checks shared by every module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They carry meaning in the data, so they are kept literally.
# ---------------------------------------------------------------------------
ACCEPTED = "Aceptada"
OBSERVED = "Observada"
REJECTED = "Rechazada"
PENDING = "Pendiente / Borrador"
NO_STATE = "SIN_ESTADO"
DEFINITIVE_STATES = ("Aceptada", "Observada", "Rechazada")
PENDING_STATES = ("Pendiente", "Borrador", "Pendiente / Borrador")

TIER_LOW, TIER_MEDIUM, TIER_HIGH = "Bajo", "Medio", "Alto"
TIERS = ("Bajo", "Medio", "Alto")
ANY_TIER = "Todos"

STATUS_ACTIVE = "ACTIVO"
DOMICILE_FOUND = "HABIDO"
NOT_FOUND = "NO_ENCONTRADO"
UNSPECIFIED = "No especificado"
MISSING_CATEGORY = "NA"

LABEL_CLEAN = "Probablemente aceptada"
LABEL_INCIDENT = "Riesgo de incidencia"
NO_REASON = "Sin factores de riesgo destacados"
REASON_STATUS = "Estado RUC"
REASON_DOMICILE = "Domicilio"
REASON_IRREGULAR = "Situacion tributaria irregular"
REASON_NEW = "Proveedor sin historial previo"
REASON_HISTORY = "Historial previo con incidencias"
REASON_AMOUNT = "Importe sobre promedio historico"
REASON_VARIANT_SUFFIX = " irregular"

MONTH_NAMES = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic")

SMOOTHING = 5.0
NO_PREVIOUS_DAYS = 9999
HISTORY_WINDOWS = (30, 90)
LATE_RATE = 0.20
MIN_RECALL = 0.60
BOOTSTRAP_ROUNDS = 120
SEED = 42
RISK_QUANTILES = (0.33, 0.85)
PLAUSIBLE_DATES = ("1990-01-01", "2100-12-31")

# ---------------------------------------------------------------------------
# Column groups
# ---------------------------------------------------------------------------
DATE_COLUMNS = ("created_ts", "issued_ts", "due_ts", "paid_ts")
LIST_FLAGS = ("is_withholding", "is_good_taxpayer", "is_fuel_perception", "is_domestic_perception")

HISTORY_FEATURES = (
    "prev_count",
    "prev_incidents",
    "prev_incident_rate",
    "prev_mean_amount",
    "prev_max_amount",
    "days_since_prev",
    "incidents_30d",
    "incidents_90d",
    "invoices_30d",
    "invoices_90d",
    "amount_deviation",
    "is_new_supplier",
)
BASE_FEATURES = (
    "doc_type",
    "currency",
    "amount",
    "log_amount",
    "issue_month",
    "issue_quarter",
    "issue_weekday",
    "term_days",
    *HISTORY_FEATURES,
)
REGISTRY_FEATURES = ("key_status", "domicile", "irregular", "registry_found", *LIST_FLAGS)
FULL_FEATURES = (*BASE_FEATURES, *REGISTRY_FEATURES)
CATEGORICAL_FEATURES = ("doc_type", "currency", "key_status", "domicile")
# Outcome columns: known only after the fact, never offered to a model.
LEAKING_COLUMNS = (
    "state",
    "flag_accepted",
    "flag_observed",
    "flag_rejected",
    "paid_ts",
    "doc_state",
    "doc_state_group",
    "issue_state",
    "incident",
)
PRIVATE_COLUMNS = ("supplier_name", "legal_name", "customer_name", "address")

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
_s, _d, _t, _i, _b, _l = (
    T.StringType(),
    T.DoubleType(),
    T.TimestampType(),
    T.IntegerType(),
    T.ByteType(),
    T.LongType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Full typed history, 27 columns.
HISTORY_SCHEMA = _struct(
    ("origin", _s),
    ("invoice_id", _s),
    ("supplier_key", _s),
    ("doc_type", _s),
    ("created_ts", _t),
    ("issued_ts", _t),
    ("due_ts", _t),
    ("paid_ts", _t),
    ("currency", _s),
    ("amount", _d),
    ("doc_state", _s),
    ("doc_state_group", _s),
    ("issue_state", _s),
    ("state", _s),
    ("payment_state", _s),
    ("flag_invoice", _b),
    ("flag_issued", _b),
    ("flag_accepted", _b),
    ("flag_observed", _b),
    ("flag_rejected", _b),
    ("flag_pending_payment", _b),
    ("year", _i),
    ("quarter_label", _s),
    ("month_number", _i),
    ("month_name", _s),
    ("year_month", _s),
    ("year_month_order", _i),
)

# Registry text file: positional columns.
REGISTRY_FILE_COLUMNS = (
    "supplier_key",
    "legal_name",
    "key_status",
    "domicile",
    "location_code",
    "street_type",
    "street_name",
    "zone_code",
    "zone_type",
    "street_number",
    "interior",
    "lot",
    "apartment",
    "block",
    "kilometer",
)
# Parts of an address, in the order in which they are written out.
ADDRESS_PARTS = (
    "street_type",
    "street_name",
    "street_number",
    "interior",
    "lot",
    "apartment",
    "block",
    "kilometer",
    "zone_type",
    "zone_code",
)
REGISTRY_REQUIRED = ("supplier_key", "key_status", "domicile", "irregular")
REGISTRY_SCHEMA = _struct(
    ("supplier_key", _s),
    ("legal_name", _s),
    ("key_status", _s),
    ("domicile", _s),
    ("location_code", _s),
    ("address", _s),
    ("irregular", _i),
    ("queried_on", T.DateType()),
    ("source", _s),
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raise ``ValueError`` naming every column that ``what`` needs and ``df`` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
