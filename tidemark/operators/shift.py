"""Distribution shift between a holdout and its training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import complement_quantiles, exact_quantiles
from tidemark.functions.scalars import ratio

_QUARTILES = (0.25, 0.5, 0.75)


def _long(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        ).alias("x"),
    ).select(*keep, "x.feature", "x.value")


def dataset_shift(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    holdout: str,
    strict: bool = True,
    day: str = "observation_day",
) -> DataFrame:
    """Prevalence, missing rates, medians and IQRs of test and training rows.

    Training rows of a holdout are all rows minus the left-out ones, so their
    statistics are totals minus left-out totals; the table is not repeated per
    holdout.  Strict splits also leave out rows of entities seen in the test.
    """
    keep = [day, holdout, "entity", label]
    slim = rows.select(*keep, *features)
    if strict:
        seen = rows.select(day, "entity", F.col(holdout).alias("h")).distinct()
        out = slim.drop(holdout).join(seen, [day, "entity"]).withColumnRenamed("h", holdout)
    else:
        out = slim
    y = F.col(label).cast("double")
    nulls = [F.sum(F.col(f).isNull().cast("long")).alias(f"null_{f}") for f in features]

    def sums(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
        got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), *nulls)
        return got.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in got.columns if c not in by])

    counted = (
        sums(slim, [day, holdout], "t_")
        .join(sums(out, [day, holdout], "o_"), [day, holdout])
        .join(sums(slim, [day], "a_"), day)
    )
    train_n = F.col("a_n") - F.col("o_n")
    base = counted.select(
        day,
        holdout,
        ratio(F.col("a_y") - F.col("o_y"), train_n).alias("training_target_prevalence"),
        ratio(F.col("t_y"), F.col("t_n")).alias("test_target_prevalence"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        ratio(F.col(f"a_null_{f}") - F.col(f"o_null_{f}"), train_n).alias("training_missing_rate"),
                        ratio(F.col(f"t_null_{f}"), F.col("t_n")).alias("test_missing_rate"),
                    )
                    for f in features
                ]
            )
        ).alias("x"),
    ).select(day, holdout, "training_target_prevalence", "test_target_prevalence", "x.*")
    long_rows = _long(slim, [day, holdout], features)
    test_q = exact_quantiles(long_rows, [day, holdout, "feature"], "value", _QUARTILES).withColumnRenamed(
        "quantiles", "tq"
    )
    train_q = complement_quantiles(
        long_rows, _long(out, [day, holdout], features), [day, "feature"], holdout, "value", _QUARTILES
    ).withColumnRenamed("quantiles", "rq")
    joined = base.join(test_q, [day, holdout, "feature"], "left").join(
        train_q, [day, holdout, "feature"], "left"
    )
    iqr = F.col("rq")[2] - F.col("rq")[0]
    return joined.select(
        day,
        holdout,
        "feature",
        "training_target_prevalence",
        "test_target_prevalence",
        (F.col("test_target_prevalence") - F.col("training_target_prevalence")).alias("target_prevalence_difference"),
        "training_missing_rate",
        "test_missing_rate",
        F.col("rq")[1].alias("training_median"),
        F.col("tq")[1].alias("test_median"),
        iqr.alias("training_iqr"),
        (F.col("tq")[2] - F.col("tq")[0]).alias("test_iqr"),
        ratio(F.col("tq")[1] - F.col("rq")[1], iqr).alias("standardized_median_difference"),
        F.coalesce(iqr == 0, F.lit(False)).alias("zero_training_iqr"),
    )


def shift_summary(
    shift: DataFrame, metrics: DataFrame, by: Sequence[str], holdout: str
) -> DataFrame:
    """Mean shift per context and its correlation with holdout metrics.

    ``metrics`` has ``by``, the holdout, ``average_precision`` and
    ``positive_rows``.  Correlations are null with fewer than two distinct
    values on either side.
    """
    per = shift.groupBy(*by, holdout).agg(
        F.avg(F.abs("standardized_median_difference")).alias("feature_shift"),
        F.abs(F.first("target_prevalence_difference")).alias("prevalence_shift"),
        F.count_if("zero_training_iqr").alias("zero_iqr"),
    )
    joined = per.join(
        metrics.select(*by, holdout, "average_precision", "positive_rows"), [*by, holdout], "left"
    )

    def correlation(other: str):
        ap, x = F.col("average_precision"), F.col(other).cast("double")
        both = ap.isNotNull() & x.isNotNull()
        a, b = F.when(both, ap), F.when(both, x)
        varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        return F.when(varied, F.corr(a, b))

    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("holdouts"),
        F.avg("feature_shift").alias("mean_absolute_standardized_median_shift"),
        F.avg("prevalence_shift").alias("mean_absolute_prevalence_difference"),
        F.sum("zero_iqr").cast("long").alias("zero_training_iqr_feature_instances"),
        correlation("feature_shift").alias("correlation_pr_auc_with_feature_shift"),
        correlation("prevalence_shift").alias("correlation_pr_auc_with_prevalence_shift"),
        correlation("positive_rows").alias("correlation_pr_auc_with_positive_count"),
    )
