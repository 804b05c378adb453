"""Order-insensitive comparison of a registered query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def duck(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def differ(df, sql, sf):
    """None, or what differs."""
    cols, rows = duck(sql, sf)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    order = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in rows)
    if a == b:
        return None
    only = [x for x in zip(a, b) if x[0] != x[1]][:2]
    return f"{len(a)} and {len(b)} rows; {str(only)[:600]}"
