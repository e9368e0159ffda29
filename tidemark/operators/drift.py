"""Reference profiles and drift of features and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import exact_quantiles
from tidemark.functions.scalars import ratio
from tidemark.operators.metrics import monitoring_calibration_error, ranking_metrics, zero_rates

# Drift levels and the histogram width.
CRITICAL, WARNING = 1.0, 0.5
BINS = 10
EPSILON = 1e-6
SCORE_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def long_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        ).alias("x")
    ).select("x.*")


def _moments(long: DataFrame) -> DataFrame:
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.avg(v.isNull().cast("double")).alias("missing_rate"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def feature_profile(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Moments, quartiles, range and a ten-bin histogram per feature."""
    long = long_features(rows, features)
    moments = _moments(long)
    quartiles = exact_quantiles(long, ["feature"], "value", (0.25, 0.5, 0.75))
    span = moments.select("feature", "min", "max")
    low = F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min"))
    high = F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max"))
    index = F.least(F.floor((F.col("value") - low) / (high - low) * BINS), F.lit(BINS - 1))
    counted = (
        long.where("value IS NOT NULL")
        .join(F.broadcast(span), "feature")
        .groupBy("feature")
        .agg(F.array(*[F.count_if(index == i) for i in range(BINS)]).alias("histogram"))
    )
    return (
        moments.join(quartiles, "feature", "left")
        .join(counted, "feature", "left")
        .select(
            "feature",
            "missing_rate",
            "mean",
            "std",
            F.col("quantiles")[1].alias("median"),
            F.col("quantiles")[0].alias("q1"),
            F.col("quantiles")[2].alias("q3"),
            "min",
            "max",
            "histogram",
        )
    )


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """Counts in ten even bins of [0, 1] as one array; 1.0 is in the last bin."""
    s = F.col(score)
    columns = []
    for i in range(BINS):
        inside = (s >= F.lit(i / BINS)) & (s < F.lit((i + 1) / BINS))
        if i == BINS - 1:
            inside = inside | (s == 1.0)
        columns.append(F.count_if(inside))
    return rows.agg(F.array(*columns).alias("histogram"))


def score_profile(rows: DataFrame, score: str, threshold: float | None = None) -> DataFrame:
    """Mean, population deviation, quantiles and histogram of a score."""
    one = F.lit(1).alias("one")
    base = rows.select(one, F.col(score).alias("s"))
    share = F.avg((F.col("s") >= F.lit(0.5 if threshold is None else float(threshold))).cast("double"))
    moments = base.groupBy("one").agg(
        F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), share.alias("share_above_threshold")
    )
    quantiles = exact_quantiles(base, ["one"], "s", SCORE_QUANTILES)
    histogram = score_histogram(base, "s").withColumn("one", F.lit(1))
    return moments.join(quantiles, "one").join(histogram, "one").select(
        "mean",
        F.col("quantiles")[3].alias("median"),
        "std",
        *[F.col("quantiles")[i].alias(f"q{round(q * 100)}") for i, q in enumerate(SCORE_QUANTILES)],
        "histogram",
        "share_above_threshold",
    )


def feature_drift(rows: DataFrame, profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing-rate, mean, median and range drift per feature with a level."""
    long = long_features(rows, features)
    reference = profile.select(
        "feature",
        F.col("missing_rate").alias("reference_missing_rate"),
        F.col("mean").alias("r_mean"),
        F.col("std").alias("r_std"),
        F.col("median").alias("r_median"),
        F.col("min").alias("r_min"),
        F.col("max").alias("r_max"),
    )
    v = F.col("value")
    outside = (v < F.col("r_min")) | (v > F.col("r_max"))
    current = (
        long.join(F.broadcast(reference.select("feature", "r_min", "r_max")), "feature")
        .groupBy("feature")
        .agg(
            F.avg(v.isNull().cast("double")).alias("missing_rate"),
            F.avg(v).alias("mean"),
            F.avg(outside.cast("double")).alias("out_of_range_rate"),
        )
    )
    medians = exact_quantiles(long, ["feature"], "value", (0.5,))
    gap = ratio(F.col("mean") - F.col("r_mean"), F.col("r_std"))
    joined = current.join(reference, "feature").join(medians, "feature", "left").withColumn("gap", gap)
    level = (
        F.when(F.abs("gap") >= CRITICAL, "critical")
        .when(F.abs("gap") >= WARNING, "warning")
        .otherwise("informational")
    )
    return joined.select(
        "feature",
        "missing_rate",
        "reference_missing_rate",
        (F.col("missing_rate") - F.col("reference_missing_rate")).alias("missing_rate_difference"),
        F.col("gap").alias("standardized_mean_difference"),
        (F.col("quantiles")[0] - F.col("r_median")).alias("median_shift"),
        "out_of_range_rate",
        level.alias("level"),
    )


def alert_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("level").agg(F.count(F.lit(1)).alias("features"))


def population_stability(reference: DataFrame, current: DataFrame) -> DataFrame:
    """PSI of two one-row histograms; the small constant is inside the log only."""
    r = reference.select(F.lit(1).alias("one"), F.col("histogram").alias("r"))
    c = current.select(F.lit(1).alias("one"), F.col("histogram").alias("c"))

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    terms = F.zip_with(
        F.transform("r", lambda x: x / total(F.col("r"))),
        F.transform("c", lambda x: x / total(F.col("c"))),
        lambda x, y: (y - x) * F.ln((y + EPSILON) / (x + EPSILON)),
    )
    return r.join(c, "one").select(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("psi"))


def score_drift(rows: DataFrame, reference_rows: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Score profile of a batch with its PSI against the reference scores."""
    psi = population_stability(score_histogram(reference_rows, score), score_histogram(rows, score))
    return score_profile(rows, score, threshold).withColumn("one", F.lit(1)).join(
        psi.withColumn("one", F.lit(1)), "one"
    ).drop("one")


def delayed_performance(rows: DataFrame, score: str, label: str, threshold: float = 0.5, aligned: bool = False) -> DataFrame:
    """Performance once labels exist; refused unless windows are aligned."""
    if not aligned:
        raise ValueError("delayed labels need exact outcome-window alignment")
    base = rows.withColumn("slice", F.lit("all"))
    report = zero_rates(ranking_metrics(base, ["slice"], score, label, threshold))
    error = monitoring_calibration_error(base, ["slice"], score, label)
    n = F.col("rows")
    return report.join(error, "slice").select(
        ratio(F.col("true_positives") + F.col("false_negatives"), n).alias("prevalence"),
        F.col("average_precision").alias("pr_auc"),
        "roc_auc",
        F.col("brier_score").alias("brier"),
        "expected_calibration_error",
        "precision",
        "recall",
        "f1",
        "true_negatives",
        "false_positives",
        "false_negatives",
        "true_positives",
        ratio(F.col("predicted_positive_rows"), n).alias("alert_rate"),
    )
