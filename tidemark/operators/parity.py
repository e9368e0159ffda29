"""Parity of two tables, coverage and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_differences(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    tolerance: float = 1e-9,
) -> DataFrame:
    """Mismatches per column, plus rows found on one side only."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    joined = a.join(b, list(keys), "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    types = dict(left.dtypes)
    counts = [
        F.count_if(F.col("b").isNull()).alias("left_only_rows"),
        F.count_if(F.col("a").isNull()).alias("right_only_rows"),
    ]
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if types[c] in ("double", "float"):
            same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        else:
            same = x.eqNullSafe(y)
        counts.append(F.count_if(both & ~same).alias(c))
    row = joined.agg(*counts)
    names = ["left_only_rows", "right_only_rows", *columns]
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("mismatches")) for n in names])
        ).alias("x")
    ).select("x.field", "x.mismatches")


def prediction_coverage(
    predictions: DataFrame, expected: DataFrame, keys: Sequence[str], label: str, expected_label: str
) -> DataFrame:
    """One-sided keys and label disagreements between two key sets."""
    p = predictions.select(*keys, F.col(label).cast("int").alias("p"), F.lit(1).alias("in_p"))
    e = expected.select(*keys, F.col(expected_label).cast("int").alias("e"), F.lit(1).alias("in_e"))
    return p.join(e, list(keys), "full_outer").agg(
        F.count_if(F.col("in_e").isNull()).alias("unexpected_predictions"),
        F.count_if(F.col("in_p").isNull()).alias("missing_predictions"),
        F.count_if(F.col("in_p").isNotNull() & F.col("in_e").isNotNull() & (F.col("p") != F.col("e"))).alias(
            "label_mismatches"
        ),
    )


def union_with_provenance(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Concatenate named tables; a key present twice fails the job."""
    union = None
    for name, df in parts.items():
        tagged = df.withColumn("prediction_provenance", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys]
    grouped = union.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.struct(*rest)).alias("row")
    )
    guard = F.when(F.col("copies") > 1, F.raise_error(F.lit("duplicate prediction key")))
    return grouped.where(F.coalesce(guard.cast("string"), F.lit("")) == "").select(
        *keys, *[F.col(f"row.{c}").alias(c) for c in rest]
    )


def shared_entities(left: DataFrame, right: DataFrame, key: str = "entity") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))
