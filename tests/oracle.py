"""Compares queries with their SQL in DuckDB, as multisets of rows with columns in order of name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in data)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def difference(spark, con, query, sql, sf_dir):
    """What differs: '' if nothing."""
    df = query(spark, sf_dir)
    names, got = rows(df.columns, df.collect())
    rel = con.execute(sql)
    want_names, want = rows([c[0] for c in rel.description], rel.fetchall())
    if names != want_names:
        return f"columns {names} / {want_names}"
    if got != want:
        return f"{sum(got.values())} / {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
    return ""
