"""Macro summaries, paired differences and worst slices of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOSSES = ("brier_score", "log_loss", "expected_calibration_error")  # fixed values


def long_metrics(results: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return results.select(
        *keep,
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
            )
        ).alias("m"),
    ).select(*keep, "m.metric", "m.value")


def macro_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, median and count per metric, nulls left out."""
    return (
        long_metrics(results, by, metrics)
        .groupBy(*by, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("standard_deviation"),
            F.percentile("value", 0.5).alias("median"),
            F.count("value").alias("contributing"),
        )
    )


def paired_differences(
    results: DataFrame,
    context: Sequence[str],
    holdout: str,
    method: str,
    pairs: dict[str, tuple[str, str]],
    metrics: Sequence[str],
) -> DataFrame:
    """Left minus right per holdout, comparison and metric, where both exist."""
    sides = sorted({m for pair in pairs.values() for m in pair})
    wide = long_metrics(results, [*context, holdout, method], metrics).groupBy(
        *context, holdout, "metric"
    ).agg(*[F.max(F.when(F.col(method) == m, F.col("value"))).alias(f"m_{m}") for m in sides])
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("comparison"), (F.col(f"m_{a}") - F.col(f"m_{b}")).alias("difference"))
            for name, (a, b) in pairs.items()
        ]
    )
    return (
        wide.select(*context, holdout, "metric", F.explode(entries).alias("d"))
        .select(*context, holdout, "metric", "d.*")
        .where(F.col("difference").isNotNull())
    )


def paired_summary(differences: DataFrame, context: Sequence[str], lower_is_better: bool = False) -> DataFrame:
    """Mean, deviation, median and favoured counts of paired differences.

    With ``lower_is_better`` the favoured side flips for loss metrics.
    """
    d = F.col("difference")
    flip = F.col("metric").isin(*_LOSSES) if lower_is_better else F.lit(False)
    gain = F.when(flip, -d).otherwise(d)
    return differences.groupBy(*context, "comparison", "metric").agg(
        F.count(F.lit(1)).alias("valid_holdouts"),
        F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("standard_deviation"),
        F.percentile("difference", 0.5).alias("median_difference"),
        F.count_if(gain > 0).alias("left_favored"),
        F.count_if(gain < 0).alias("right_favored"),
        F.count_if(d == 0).alias("ties"),
    )


def worst_slices(
    results: DataFrame, by: Sequence[str], holdout: str, measures: dict[str, tuple[str, str]]
) -> DataFrame:
    """Worst holdout per measure; ``measures`` maps name to (metric, "min" or "max").

    Ties go to the smallest holdout id; undefined metrics do not compete.
    """
    picks = []
    for name, (metric, side) in measures.items():
        v = F.col(metric).cast("double")
        key = F.struct((v if side == "min" else -v).alias("k"), F.col(holdout).alias("h"), v.alias("v"))
        best = F.min(F.when(v.isNotNull(), key))
        picks.append((name, best))
    wide = results.groupBy(*by).agg(*[b.alias(n) for n, b in picks])
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("worst_measure"), F.col(n).getField("h").alias("holdout"), F.col(n).getField("v").alias("value"))
            for n, _ in picks
        ]
    )
    return wide.select(*by, F.explode(entries).alias("w")).select(*by, "w.*").where(F.col("holdout").isNotNull())


def overlap_totals(results: DataFrame, split: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Overlap diagnostics summed over splits, each split counted once."""
    columns = ["overlapping_entities", "removed_entities", "removed_rows"]
    return (
        results.groupBy(*split)
        .agg(*[F.max(c).alias(c) for c in columns])
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("holdouts"), *[F.sum(c).cast("long").alias(c) for c in columns])
    )
