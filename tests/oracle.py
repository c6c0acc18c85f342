"""Holds queries against their SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def differences(df, sql: str, con) -> str | None:
    """None if equal, or what differs first."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    cols = sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    for c, k in df.dtypes:
        if kinds.get(k, types[c]) != types[c]:
            return f"type of {c}: {k} and {types[c]}"
    a = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if a != b:
        x, y = next(((x, y) for x, y in zip(a, b) if x != y), (None, None))
        return f"{len(a)} and {len(b)} rows, first: {str(x)[:300]} and {str(y)[:300]}"
    return None
