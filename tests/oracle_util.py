"""Helpers shared by the oracle test and ``tools/oracle_check.py``: DuckDB views over the
test tables and an order-insensitive digest of a result."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


STRICT = os.environ.get("ORACLE_STRICT", "1") == "1"


def normalise(value):
    if STRICT and isinstance(value, float):
        return repr(value)
    if STRICT and isinstance(value, decimal.Decimal):
        return str(value)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        f = float(value)
        if math.isnan(f):
            return "NaN"
        if f == int(f) and abs(f) < 1e15:
            return str(int(f))
        return f"{f:.12g}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(normalise(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con
