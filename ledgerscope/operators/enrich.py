"""Registry and membership lists: keyed deduplication, joins, upsert and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.functions.risk import incident_target, irregular_flag
from ledgerscope.functions.temporal import strict_date, strict_int
from ledgerscope.functions.text import blank_to_null, clean_upper, join_address, normalize_key
from ledgerscope.operators.profile import term_days
from ledgerscope.operators.skew import BROADCAST_ROWS, join_many_to_one, semi_join_keys


# --------------------------------------------------------------------------- dedup and keys
def dedup_by_key(df: DataFrame, key: str, order: str | Sequence[str], *, keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in the order of ``order``.

    A max/min over structs is combined on the map side, so a key repeated in a third of the rows
    costs no more than any other.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c != key and c not in order]
    pick = {"last": F.max, "first": F.min}[keep]
    chosen = df.groupBy(key).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return chosen.select(*[F.col(c) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def distinct_keys(df: DataFrame, raw_key: str = "raw_key") -> DataFrame:
    key = normalize_key(F.col(raw_key)).alias("supplier_key")
    return df.select(key).where(F.col("supplier_key").isNotNull()).distinct()


def missing_keys(
    wanted: DataFrame, found: DataFrame, key: str = "supplier_key", *, small: bool | None = None
) -> DataFrame:
    """Wanted keys that were not found."""
    return semi_join_keys(wanted.select(key).distinct(), found, key, how="left_anti", small=small)


# --------------------------------------------------------------------------- registry
def normalize_dimension(df: DataFrame, order: str, raw_key: str = "supplier_key") -> DataFrame:
    """Registry with every field, normalized keys, one row per key (the last in ``order``)."""
    S.require_columns(df, (raw_key, *[c for c in S.REGISTRY_REQUIRED if c != "supplier_key"]), "registry")
    types = {f.name: f.dataType for f in S.REGISTRY_SCHEMA.fields}
    fields = {
        name: F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        for name, kind in types.items()
        if name != "supplier_key"
    }
    keyed = df.select(
        normalize_key(F.col(raw_key)).alias("supplier_key"),
        *[expr.alias(name) for name, expr in fields.items()],
        F.col(order).alias("_order"),
    ).where(F.col("supplier_key").isNotNull())
    return dedup_by_key(keyed, "supplier_key", "_order").select(*types)


def filter_registry(
    registry: DataFrame, wanted: DataFrame, order: str = "line_no", *, small: bool | None = None
) -> DataFrame:
    """Registry rows of the wanted suppliers, cleaned, one per key.

    The key test runs in the scan stage, before the text work, so the bulk of the registry is
    dropped as it is read.
    """
    S.require_columns(registry, ("supplier_key", "legal_name", "key_status", "domicile", "location_code"), "registry")
    keyed = registry.withColumn("supplier_key", normalize_key(F.col("supplier_key")))
    matched = semi_join_keys(keyed, wanted, "supplier_key", small=small)
    if "address" in registry.columns:
        address = F.trim(F.coalesce("address", F.lit("")))
    else:
        address = join_address(*[F.col(c) for c in S.ADDRESS_PARTS if c in registry.columns])
    cleaned = matched.select(
        "supplier_key",
        F.trim(F.coalesce("legal_name", F.lit(""))).alias("legal_name"),
        clean_upper(F.col("key_status")).alias("key_status"),
        clean_upper(F.col("domicile")).alias("domicile"),
        F.trim(F.coalesce("location_code", F.lit(""))).alias("location_code"),
        address.alias("address"),
        F.col(order).alias("_order"),
    )
    flagged = cleaned.withColumn("irregular", irregular_flag(F.col("key_status"), F.col("domicile")))
    return dedup_by_key(flagged, "supplier_key", "_order").drop("_order")


def registry_report(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted, found and missing keys; regular and irregular suppliers."""
    marked = wanted.select("supplier_key").distinct().join(
        found.select("supplier_key", "irregular"), "supplier_key", "left"
    )
    is_found = F.col("irregular").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count_if(is_found).alias("found"),
        F.count_if(~is_found).alias("missing"),
        F.count_if(F.col("irregular") == 0).alias("regular"),
        F.count_if(F.col("irregular") == 1).alias("irregular"),
    )


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise when a key occurs twice; one partially aggregated count and a limit."""
    repeated = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"key {key} is not unique, e.g. {repeated[0][key]!r}")


def enrich_invoices(
    invoices: DataFrame,
    registry: DataFrame,
    *,
    check_unique: bool = True,
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add registry fields and ``registry_found``; suppliers not found get the agreed fill values."""
    if check_unique:
        assert_unique(registry, "supplier_key")
    dim = registry.where(F.col("supplier_key").isNotNull()).withColumn("_found", F.lit(1))
    joined = join_many_to_one(invoices, dim, "supplier_key", small=small, broadcast_rows=broadcast_rows)
    return joined.withColumns(
        {
            "registry_found": F.coalesce("_found", F.lit(0)),
            "irregular": F.coalesce(F.col("irregular").cast("int"), F.lit(-1)),
            "key_status": F.coalesce("key_status", F.lit(S.NOT_FOUND)),
            "domicile": F.coalesce("domicile", F.lit(S.NOT_FOUND)),
        }
    ).drop("_found")


def merged_dimension(registry: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Registry and flags as one table, one row per supplier of either; ``_found`` marks those of the registry."""
    dim = registry.where(F.col("supplier_key").isNotNull()).withColumn("_found", F.lit(1))
    if flags is None:
        return dim.withColumns({f: F.lit(0) for f in S.LIST_FLAGS})
    known = flags.where(F.col("supplier_key").isNotNull())
    known = known.select("supplier_key", *[F.col(f).cast("int").alias(f) for f in S.LIST_FLAGS])
    return dim.drop(*S.LIST_FLAGS).join(known, "supplier_key", "full")


def fill_dimension(joined: DataFrame) -> DataFrame:
    """The agreed values for invoices whose supplier is not in the registry or in no list."""
    return joined.withColumns(
        {
            "registry_found": F.coalesce("_found", F.lit(0)),
            "irregular": F.coalesce(F.col("irregular").cast("int"), F.lit(-1)),
            "key_status": F.coalesce("key_status", F.lit(S.NOT_FOUND)),
            "domicile": F.coalesce("domicile", F.lit(S.NOT_FOUND)),
            **{f: F.coalesce(f, F.lit(0)) for f in S.LIST_FLAGS},
        }
    ).drop("_found")


def enrich_with_flags(
    invoices: DataFrame,
    registry: DataFrame,
    flags: DataFrame | None,
    *,
    check_unique: bool = True,
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    **options: int,
) -> DataFrame:
    """Registry fields and membership flags in one join: the dimensions meet first, and the invoices move once at most."""
    if check_unique:
        assert_unique(registry, "supplier_key")
    dim = merged_dimension(registry, flags)
    joined = join_many_to_one(invoices, dim, "supplier_key", small=small, broadcast_rows=broadcast_rows, **options)
    last = ["registry_found", *S.LIST_FLAGS]
    filled = fill_dimension(joined)
    return filled.select(*[c for c in filled.columns if c not in last], *last)


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """Rows and suppliers with and without a registry entry."""
    found = F.col("registry_found") == 1
    return enriched.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(found).alias("rows_found"),
        F.count_if(~found).alias("rows_missing"),
        F.count_distinct(F.when(found, F.col("supplier_key"))).alias("suppliers_found"),
        F.count_distinct(F.when(~found, F.col("supplier_key"))).alias("suppliers_missing"),
    )


# --------------------------------------------------------------------------- membership lists
def build_flags(wanted: DataFrame, lists: Mapping[str, DataFrame]) -> DataFrame:
    """0/1 membership of each wanted key in each list; a list that is not given is all zero.

    Lists are stacked and aggregated once, so the wanted keys are joined once, not once per list.
    """
    members = None
    for flag, table in lists.items():
        keys = table.select("supplier_key", F.lit(flag).alias("flag"))
        members = keys if members is None else members.unionByName(keys)
    keys = wanted.select("supplier_key").distinct()
    if members is None:
        return keys.select("supplier_key", *[F.lit(0).alias(f) for f in S.LIST_FLAGS])
    wide = members.where(F.col("supplier_key").isNotNull()).groupBy("supplier_key").agg(
        *[F.max((F.col("flag") == f).cast("int")).alias(f) for f in S.LIST_FLAGS]
    )
    joined = keys.join(wide, "supplier_key", "left")
    return joined.select("supplier_key", *[F.coalesce(f, F.lit(0)).alias(f) for f in S.LIST_FLAGS])


def add_membership_flags(
    invoices: DataFrame,
    flags: DataFrame | None,
    *,
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Flags per invoice; 0 for suppliers that are in no list and when no lists exist."""
    if flags is None:
        return invoices.withColumns({f: F.lit(0) for f in S.LIST_FLAGS})
    known = flags.select("supplier_key", *S.LIST_FLAGS)
    joined = join_many_to_one(invoices, known, "supplier_key", small=small, broadcast_rows=broadcast_rows)
    return joined.withColumns({f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in S.LIST_FLAGS})


# --------------------------------------------------------------------------- upsert
_SET_FIELDS = tuple(f.name for f in S.REGISTRY_SCHEMA.fields if f.name != "supplier_key")


def prepare_upsert_source(
    registry: DataFrame, flags: DataFrame | None, order: str, *, strict: bool = True
) -> DataFrame:
    """Rows ready to be written: normalized key, blanks as null, typed fields, optional flags.

    ``strict`` fails the job on a date or flag that cannot be read; otherwise it becomes null.
    """
    types = {f.name: f.dataType for f in S.REGISTRY_SCHEMA.fields}

    def typed(name: str) -> Column:
        if name not in registry.columns:
            return F.lit(None).cast(types[name])
        value = F.col(name)
        if name == "queried_on":
            return strict_date(value) if strict else value.try_cast("date")
        if name == "irregular":
            return strict_int(value) if strict else value.try_cast("int")
        return blank_to_null(value.cast("string"))

    rows = registry.select(
        normalize_key(F.col("supplier_key")).alias("supplier_key"),
        *[typed(name).alias(name) for name in _SET_FIELDS],
        F.col(order).alias("_order"),
    ).where(F.col("supplier_key").isNotNull())
    rows = dedup_by_key(rows, "supplier_key", "_order").drop("_order")
    if flags is None:
        return rows.withColumns({f: F.lit(None).cast("int") for f in S.LIST_FLAGS})
    return rows.join(flags.select("supplier_key", *[F.col(f).cast("int") for f in S.LIST_FLAGS]), "supplier_key", "left")


def classify_upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """Full outer join on the key with the merged values and what happens to each row.

    Base fields of the source overwrite, nulls included. A flag that the source does not know keeps
    the value of the target. ``action`` is inserted, updated, unchanged, or kept (target only).
    """
    fields = (*_SET_FIELDS, *S.LIST_FLAGS)
    old = target.select("supplier_key", F.struct(*fields).alias("old"))
    new = source.select("supplier_key", F.struct(*fields).alias("new"))
    both = old.join(new, "supplier_key", "full")
    has_new = F.col("new").isNotNull()
    merged = {f: F.when(has_new, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")) for f in _SET_FIELDS}
    merged |= {f: F.coalesce(F.col(f"new.{f}"), F.col(f"old.{f}")) for f in S.LIST_FLAGS}
    same = F.lit(True)
    for f, value in merged.items():
        same = same & value.eqNullSafe(F.col(f"old.{f}"))
    action = (
        F.when(~has_new, "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return both.select("supplier_key", *[v.alias(f) for f, v in merged.items()], action.alias("action"))


def upsert_stats(classified: DataFrame) -> DataFrame:
    action = F.col("action")
    return classified.agg(
        F.count_if(action != "kept").alias("read"),
        F.count_if(action == "inserted").alias("inserted"),
        F.count_if(action == "updated").alias("updated"),
        F.count_if(action == "unchanged").alias("unchanged"),
    )


# --------------------------------------------------------------------------- derived columns
def derive_columns(df: DataFrame) -> DataFrame:
    """Calendar, term and amount columns and the target."""
    issued = F.col("issued_ts")
    return df.withColumns(
        {
            "term_days": term_days(F.col("due_ts"), issued),
            "issue_month": F.month(issued),
            "issue_year": F.year(issued),
            "issue_quarter": F.quarter(issued),
            "issue_weekday": F.weekday(issued),
            "log_amount": F.log1p(F.abs("amount")),
            "incident": incident_target(F.col("state")),
        }
    )


def definitive(df: DataFrame) -> DataFrame:
    return df.where(F.col("state").isin(*S.DEFINITIVE_STATES))


def pending(df: DataFrame) -> DataFrame:
    return df.where(F.col("state").isin(*S.PENDING_STATES))


def preparation_report(df: DataFrame) -> DataFrame:
    """One row: totals, matches, target distribution, incident share and nulls that matter."""
    state, found = F.col("state"), F.col("registry_found") == 1
    is_definitive = state.isin(*S.DEFINITIVE_STATES)
    watched = (
        "supplier_key",
        "amount",
        "issued_ts",
        "due_ts",
        "term_days",
        "irregular",
        "key_status",
        "domicile",
        "registry_found",
        "incident",
    )
    n_definitive, n_incidents = F.count_if(is_definitive), F.count_if(is_definitive & (F.col("incident") == 1))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        n_definitive.alias("definitive"),
        F.count_if(state.isin(*S.PENDING_STATES)).alias("pending"),
        F.count_if(found).alias("rows_found"),
        F.count_if(~found).alias("rows_missing"),
        F.count_distinct(F.when(found, F.col("supplier_key"))).alias("suppliers_found"),
        F.count_distinct(F.when(~found, F.col("supplier_key"))).alias("suppliers_missing"),
        F.count_if(is_definitive & (F.col("incident") == 0)).alias("clean"),
        n_incidents.alias("incidents"),
        F.round(F.coalesce(F.try_divide(n_incidents * 100.0, n_definitive), F.lit(0.0)), 4).alias("incident_pct"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in watched if c in df.columns],
    )
