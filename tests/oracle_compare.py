"""Run a registered report in Spark and its SQL twin in DuckDB, and compare.

Comparison mirrors the correctness gate: same row count, same column
names, and the same multiset of rows after sorting columns by name.
Floats compare exactly unless ``rel_tol`` is given.
"""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__) if v is not None else "", v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str, rel_tol: float = 0.0) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = [tuple(_norm(v) for _, v in sorted(zip(d_cols, r), key=lambda x: x[0])) for r in res.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    s_sorted = sorted(s_rows, key=lambda r: tuple(str(x) for x in r))
    d_sorted = sorted(d_rows, key=lambda r: tuple(str(x) for x in r))
    for a, b in zip(s_sorted, d_sorted):
        for col, x, y in zip(sorted(s_cols), a, b):
            if isinstance(x, float) and isinstance(y, float) and rel_tol:
                if not math.isclose(x, y, rel_tol=rel_tol):
                    return False, f"{col}: {x!r} != {y!r}"
            elif isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if x != y or type(x) is not type(y):
                    return False, f"{col}: {x!r} ({type(x).__name__}) != {y!r} ({type(y).__name__})"
            elif x != y:
                return False, f"{col}: {x!r} != {y!r}"
    return True, f"{len(s_rows)} rows"
