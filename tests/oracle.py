"""Compare a query with its SQL twin, value by value, whatever the order of rows and columns."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal | int | float):
        f = float(v)
        return None if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _close(a: tuple, b: tuple) -> bool:
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, show: int = 5) -> list[str]:
    """What differs, empty if nothing."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    a, b = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, want.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}", *[f"only here: {x}" for x in [x for x in a if x not in set(b)][:show]], *[f"only in SQL: {x}" for x in [x for x in b if x not in set(a)][:show]]]
    return [f"{x} against {y}" for x, y in zip(a, b, strict=True) if not _close(x, y)][:show]
