"""Run a query in Spark and its SQL in DuckDB and compare values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return f"bool:{value}"
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(query, sql: str, spark, sf_dir: str, con):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_columns, want = canonical(names, cur.fetchall())
    if got_columns != want_columns:
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; "
            f"{sum((got - want).values())} differ\n  columns {got_columns}\n  spark {extra}\n  oracle {missing}"
        )
    if not got:
        return "EMPTY"
    return None
