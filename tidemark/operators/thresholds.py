"""Threshold sweeps and threshold policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio_or_zero
from tidemark.operators.metrics import score_counts, score_curve
from tidemark.schema import ABOVE_ALL_SCORES


def _point(threshold: Column, tp: Column, fp: Column, pos: Column, neg: Column) -> list[Column]:
    precision = ratio_or_zero(tp, tp + fp)
    recall = ratio_or_zero(tp, pos)
    return [
        threshold.cast("double").alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or_zero(2 * precision * recall, precision + recall).alias("f1"),
        ratio_or_zero(tp + fp, pos + neg).alias("alert_rate"),
        tp.cast("long").alias("true_positives"),
        fp.cast("long").alias("false_positives"),
        (pos - tp).cast("long").alias("false_negatives"),
        (neg - fp).cast("long").alias("true_negatives"),
    ]


def threshold_candidates(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Every distinct score as a threshold, plus warn-none and warn-all."""
    counts = score_counts(df, by, score, label)
    curve = score_curve(counts, by).select(
        *by, *_point(F.col("score"), F.col("cum_pos"), F.col("cum_neg"), F.col("all_pos"), F.col("all_neg"))
    )
    ends = counts.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.min("score").alias("lowest")
    )
    zero = F.lit(0)
    none = ends.select(*by, *_point(F.lit(ABOVE_ALL_SCORES), zero, zero, F.col("p"), F.col("q")))
    everything = ends.where("lowest <> 0").select(
        *by, *_point(F.lit(0.0), F.col("p"), F.col("q"), F.col("p"), F.col("q"))
    )
    return curve.unionByName(none).unionByName(everything)


_FIELDS = [
    "threshold",
    "precision",
    "recall",
    "f1",
    "alert_rate",
    "true_positives",
    "false_positives",
    "false_negatives",
    "true_negatives",
]


def select_thresholds(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    label: str,
    fixed: float = 0.5,
    recall_target: float = 0.8,
    alert_capacity: float = 0.1,
    false_negative_cost: float = 5,
    false_positive_cost: float = 1,
) -> DataFrame:
    """Five policies per slice, chosen by one aggregate over the candidates.

    Ties: recall prefers the highest threshold, then precision; F1 prefers
    recall, then the highest threshold; capacity prefers the lowest threshold;
    cost prefers recall, then the highest threshold.
    """
    points = threshold_candidates(df, by, score, label).withColumn(
        "cost",
        F.lit(float(false_negative_cost)) * F.col("false_negatives")
        + F.lit(float(false_positive_cost)) * F.col("false_positives"),
    )
    row = F.struct(*_FIELDS).alias("point")

    def best(condition: Column | None, *order: Column) -> Column:
        key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], row)
        return F.max(key if condition is None else F.when(condition, key)).getField("point")

    t, r, p = F.col("threshold"), F.col("recall"), F.col("precision")
    picked = points.groupBy(*by).agg(
        best(r >= recall_target, t, p).alias("feasible"),
        best(None, r, p, t).alias("fallback"),
        best(None, F.col("f1"), r, t).alias("f1_focused"),
        best(F.col("alert_rate") <= alert_capacity, r, -t).alias("alert_capacity"),
        best(None, -F.col("cost"), r, t).alias("cost_sensitive"),
        best(t >= fixed, -t).alias("at_fixed"),
    )
    at = F.col("at_fixed")
    fixed_row = F.struct(
        F.lit(float(fixed)).alias("threshold"), *[at.getField(f).alias(f) for f in _FIELDS[1:]]
    )
    chosen = F.array(
        *[
            F.struct(F.lit(name).alias("threshold_policy"), c.alias("point"), fb.alias("selection_fallback"))
            for name, c, fb in (
                ("fixed", fixed_row, F.lit(False)),
                ("recall_focused", F.coalesce("feasible", "fallback"), F.col("feasible").isNull()),
                ("f1_focused", F.col("f1_focused"), F.lit(False)),
                ("alert_capacity", F.col("alert_capacity"), F.lit(False)),
                ("cost_sensitive", F.col("cost_sensitive"), F.lit(False)),
            )
        ]
    )
    return picked.select(*by, F.explode(chosen).alias("c")).select(
        *by, "c.threshold_policy", "c.point.*", "c.selection_fallback"
    )


def tradeoff_curve(df: DataFrame, by: Sequence[str], score: str, label: str, steps: int = 100) -> DataFrame:
    """Metrics at ``steps + 1`` even thresholds.

    Scores are counted per threshold interval, so the cumulative window sees at
    most ``steps + 2`` rows per slice.
    """
    step = 1.0 / steps
    s = F.col("score")
    low = F.floor(s * steps)
    level = (
        F.when(((low + 1) * step) <= s, low + 1).when((low * step) > s, low - 1).otherwise(low)
    )
    counted = (
        score_counts(df, by, score, label)
        .groupBy(*by, F.least(F.greatest(level, F.lit(-1)), F.lit(steps)).cast("int").alias("level"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    grid = (
        counted.select(*by)
        .distinct()
        .select(
            *by,
            F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("level"),
            F.lit(0).cast("long").alias("pos"),
            F.lit(0).cast("long").alias("neg"),
        )
    )
    filled = counted.unionByName(grid).groupBy(*by, "level").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    above = part.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = filled.select(
        *by,
        "level",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("neg").over(whole).alias("q"),
    ).where("level >= 0")
    return run.select(
        *by, *_point(F.col("level") * step, F.col("tp"), F.col("fp"), F.col("p"), F.col("q"))
    )


def policy_summary(
    thresholds: DataFrame,
    decisions: DataFrame,
    by: Sequence[str],
    false_negative_cost: float = 5,
    false_positive_cost: float = 1,
) -> DataFrame:
    """Selected-threshold spread and pooled held-out metrics per policy.

    ``decisions`` is long: ``by`` (including ``threshold_policy``),
    ``actual_label`` and ``decision``.
    """
    from tidemark.operators.metrics import confusion, zero_rates

    spread = thresholds.groupBy(*by).agg(
        F.avg("selected_threshold").alias("selected_threshold_mean"),
        F.stddev_samp("selected_threshold").alias("selected_threshold_standard_deviation"),
    )
    pooled = zero_rates(confusion(decisions, by, "actual_label", "decision"))
    return (
        spread.join(pooled, list(by))
        .withColumn("alert_rate", F.col("predicted_positive_rows") / F.col("rows"))
        .withColumn(
            "cost",
            F.lit(float(false_negative_cost)) * F.col("false_negatives")
            + F.lit(float(false_positive_cost)) * F.col("false_positives"),
        )
    )


def long_decisions(predictions: DataFrame, policies: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per prediction and policy: policy, threshold and decision."""
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("threshold_policy"),
                F.col(f"{p}_threshold").cast("double").alias("selected_threshold"),
                F.col(f"{p}_prediction").cast("int").alias("decision"),
            )
            for p in policies
        ]
    )
    return predictions.select(*keep, F.explode(entries).alias("d")).select(*keep, "d.*")


def decision_mismatches(predictions: DataFrame, policies: Sequence[str], score: str = "calibrated_output") -> DataFrame:
    """Checked rows and saved decisions that their threshold does not reproduce."""
    rows = long_decisions(predictions, policies, [score])
    expected = (F.col(score) >= F.col("selected_threshold")).cast("int")
    return rows.groupBy("threshold_policy").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(expected != F.col("decision")).alias("mismatches")
    )


def prediction_violations(predictions: DataFrame, policies: Sequence[str], score: str = "calibrated_output") -> DataFrame:
    """Counts of invalid labels, scores, decisions and holdout ids."""
    bad_decision = None
    for p in policies:
        term = ~F.col(f"{p}_prediction").isin(0, 1)
        bad_decision = term if bad_decision is None else bad_decision | term
    return predictions.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.col("actual_label").isin(0, 1)).alias("invalid_labels"),
        F.count_if((F.col(score) < 0) | (F.col(score) > 1)).alias("invalid_scores"),
        F.count_if(bad_decision).alias("invalid_decisions"),
        F.count_if(F.col("outer_holdout_id") != F.concat_ws("_", "unit", "period")).alias("foreign_holdouts"),
    )
