"""Registry of (query, oracle SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(column: Column | str) -> Column:
    """Round to 6 places; adding zero turns -0.0 into 0.0.

    Rounding to 10 places first removes the noise of summation order, which
    would otherwise decide exact ties in the seventh place.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.round(c.cast("double"), 10), 6) + F.lit(0.0)


def tidy(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Round doubles, turn booleans into 0/1 and arrays into joined text."""
    out = []
    for field in df.schema.fields:
        if keep is not None and field.name not in keep:
            continue
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            c = r6(c)
        elif kind == "boolean":
            c = c.cast("int")
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("long")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def tidy_sql(columns: dict[str, str], source: str) -> str:
    """``SELECT`` list matching ``tidy``: kind is one of d, b, i, s, a."""
    wrap = {
        "d": "round(round(CAST({c} AS DOUBLE), 10), 6) + 0.0",
        "b": "CAST({c} AS BIGINT)",
        "i": "CAST({c} AS BIGINT)",
        "s": "{c}",
        "a": "array_to_string({c}, ',')",
    }
    parts = [f"{wrap[k].format(c=c)} AS {c}" for c, k in columns.items()]
    return f"SELECT {', '.join(parts)} FROM {source}"
