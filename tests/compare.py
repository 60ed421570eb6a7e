"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.01"
SMOKE_DIR = "/root/testdata/sf0.001"


def plain(value):
    """A value that compares alike from either engine: doubles to 9 digits, times without zone."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, in_order(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], in_order(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


def assert_same(df, sql: str, sf_dir: str = SF_DIR) -> int:
    names, ours = spark_rows(df)
    columns, theirs = duck_rows(sql, sf_dir)
    assert names == columns
    assert len(ours) == len(theirs)
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(close, a, b))]
    assert not odd, f"{len(odd)} of {len(ours)} rows differ, first {odd[:2]} of {names}"
    return len(ours)
