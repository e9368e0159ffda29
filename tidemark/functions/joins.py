"""Joins that stay even under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(
    fact: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread: str,
    how: str = "left",
    salts: int = 32,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join a fact table to a lookup with unique keys.

    A lookup whose estimate is within ``limit`` is joined without a hint:
    estimates do not see rows that an explode adds, so adaptive execution
    decides on a broadcast by the size it measures.  Otherwise the fact side is salted by a hash of ``spread`` and the lookup is
    repeated once per salt, so one hot key is shared by ``salts`` tasks.
    """
    keys = list(keys)
    if estimated_bytes(dimension) <= limit:
        return fact.join(dimension, keys, how)
    salted_fact = fact.withColumn("salt", F.pmod(F.hash(F.col(spread)), F.lit(salts)))
    salted_dim = dimension.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_fact.join(salted_dim, [*keys, "salt"], how).drop("salt")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def last_row_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("kept")
    ).select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest])


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Raise inside the job when a key occurs twice; rows pass through."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.struct(*rest)).alias("kept")
    )
    guard = F.when(
        F.col("copies") > 1,
        F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.to_json(F.struct(*keys)))),
    )
    return grouped.withColumn("guard", guard.cast("string")).where(
        F.col("guard").isNull()
    ).select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest])
