"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Rows are compared as multisets after normalising values (decimals and floats
to rounded floats, dates and timestamps to ISO text), with columns in name
order — the same shape of check the project's correctness gate applies.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

from tripstar.sources.tables import RAW_TABLES

ORACLE_TABLES = RAW_TABLES + ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in ORACLE_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalars
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def normalise(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def digest(rows: list[tuple]) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()


def compare(spark, sf_dir: str, name: str, query_fn, sql: str | None, con=None) -> dict:
    df = query_fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = {"query": name, "spark_rows": len(s_rows), "columns": s_cols}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duckdb_connection(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    res["oracle_rows"] = len(d_rows)
    res["columns_match"] = sorted(s_cols) == sorted(d_cols)
    a, b = normalise(s_cols, s_rows), normalise(d_cols, d_rows)
    res["values_match"] = a == b
    if not res["values_match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diff
        if not res["columns_match"]:
            res["oracle_columns"] = d_cols
    res["status"] = "ok" if (res["columns_match"] and res["values_match"]
                             and len(s_rows) == len(d_rows)) else "MISMATCH"
    return res
