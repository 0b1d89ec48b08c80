"""Compares a Spark result with the result of its oracle SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_KINDS = {
    "bigint": "int", "integer": "int", "smallint": "int", "tinyint": "int", "int": "int", "hugeint": "huge",
    "double": "float", "float": "float", "varchar": "text", "string": "text", "boolean": "bool", "date": "date",
    "timestamp": "time", "timestamp_ntz": "time",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(table, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(df, con, sql: str) -> str | None:
    """``None`` when both agree, else the first difference."""
    con.execute(f"CREATE OR REPLACE TEMP VIEW asked AS {sql}")  # as a checker may do, which refuses some statements
    result = con.execute("SELECT * FROM asked")
    names = [d[0] for d in result.description]
    kinds = {d[0]: _KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in result.description}
    rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(df.dtypes)
    different = {c: (types[c], kinds[c]) for c in names if _KINDS.get(types[c], types[c]) != kinds[c]}
    ours = [tuple(r) for r in df.collect()]
    if len(ours) != len(rows):
        return f"rows {len(ours)} != {len(rows)}"
    left, right = _sorted_rows(df.columns, ours), _sorted_rows(names, rows)
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if bad:
        return f"{len(bad)} rows differ ({sorted(names)}), first: {bad[0][0]} != {bad[0][1]}"
    if different:
        return f"types differ: {different}"
    return None
