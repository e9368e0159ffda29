"""Subgroup audit of saved predictions with support suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.joins import assert_unique
from tidemark.functions.ranking import exact_quantiles
from tidemark.functions.scalars import attempts_band, credit_band, group_label, ratio, recorded
from tidemark.schema import ENTITY_KEYS, UNIT_KEYS, UNKNOWN_GROUP


@dataclass(frozen=True)
class Support:
    """Smallest counts at which a group's metrics are shown."""

    rows: int = 50
    entities: int = 25
    positives: int = 10
    negatives: int = 10
    predicted_positives: int = 10


# Published default supports and metric lists.
GROUP_SUPPORT = Support()
INTERSECTION_SUPPORT = Support(100, 50, 15, 15, 10)
METRICS = (
    "outcome_prevalence",
    "warning_rate",
    "recall",
    "false_negative_rate",
    "specificity",
    "false_positive_rate",
    "precision",
    "negative_predictive_value",
    "f1",
    "balanced_accuracy",
    "mean_calibrated_output",
    "brier_score",
    "expected_calibration_error",
)
DISPARITY_METRICS = (
    "warning_rate",
    "recall",
    "false_negative_rate",
    "false_positive_rate",
    "precision",
    "brier_score",
    "expected_calibration_error",
)
ADJUSTED_METRICS = ("warning_rate", "recall", "false_positive_rate", "brier_score")


def labelled_attributes(
    info: DataFrame, attributes: Sequence[str], attempts: str | None = None, credits: str | None = None
) -> DataFrame:
    """Normalised attribute labels and bands per enrolment.

    Credit bounds are quartiles of all recorded values of ``info``.
    """
    columns = [F.col(k) for k in ENTITY_KEYS] + [group_label(F.col(a)).alias(a) for a in attributes]
    source = info
    if attempts is not None:
        columns.append(attempts_band(F.col(attempts)).alias(attempts))
    if credits is not None:
        numbers = info.select(F.lit(1).alias("one"), recorded(F.col(credits)).cast("double").alias("c"))
        bounds = exact_quantiles(numbers, ["one"], "c", (0.25, 0.5, 0.75)).select(
            "one", F.array_distinct("quantiles").alias("bounds")
        )
        source = info.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one", "left")
        columns.append(credit_band(F.col(credits), F.col("bounds")).alias(credits))
    return source.select(*columns)


def join_attributes(predictions: DataFrame, labelled: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Left join on the enrolment; misses are Unknown and row counts hold."""
    unique = assert_unique(labelled.select(*ENTITY_KEYS, *attributes), ENTITY_KEYS, "enrolment")
    joined = predictions.join(unique, ENTITY_KEYS, "left")
    return joined.withColumns({a: F.coalesce(a, F.lit(UNKNOWN_GROUP)) for a in attributes})


def preferred_attributes(first: DataFrame, fallback: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Attributes from ``first`` where an enrolment is there, else from ``fallback``."""
    a = first.select(*ENTITY_KEYS, F.struct(*[group_label(F.col(c)).alias(c) for c in attributes]).alias("a"))
    b = fallback.select(*ENTITY_KEYS, F.struct(*[group_label(F.col(c)).alias(c) for c in attributes]).alias("b"))
    both = a.join(b, ENTITY_KEYS, "full_outer").withColumn("x", F.coalesce("a", "b"))
    return both.select(*ENTITY_KEYS, *[F.col(f"x.{c}").alias(c) for c in attributes])


def _counts(
    rows: DataFrame, by: Sequence[str], policies: Sequence[str], score: str, label: str, bins: int = 10
) -> DataFrame:
    """One aggregation per group; policy decisions are conditional sums of it."""
    s, y = F.col(score), F.col(label).cast("long")
    index = F.when(s == 1.0, F.lit(bins - 1))
    for i in range(bins):
        index = index.when((s >= F.lit(i / bins)) & (s < F.lit((i + 1) / bins)), F.lit(i))
    rows = rows.withColumn("bin", index)
    hits = []
    for p in policies:
        d = F.col(f"{p}_prediction") == 1
        hits += [
            F.count_if((y == 1) & d).alias(f"tp_{p}"),
            F.count_if((y == 0) & d).alias(f"fp_{p}"),
        ]
    grouped = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("entity").alias("unique_entities"),
        F.sum(y).alias("positive_cases"),
        F.sum(s).alias("score_sum"),
        F.sum(F.pow(s - y, F.lit(2.0))).alias("square_sum"),
        *[F.sum(F.when(F.col("bin") == i, s - y).otherwise(0.0)).alias(f"gap_{i}") for i in range(bins)],
        *hits,
    )
    entries = F.array(
        *[
            F.struct(F.lit(p).alias("threshold_policy"), F.col(f"tp_{p}").alias("tp"), F.col(f"fp_{p}").alias("fp"))
            for p in policies
        ]
    )
    gaps = None
    for i in range(bins):
        gap = F.abs(F.col(f"gap_{i}"))
        gaps = gap if gaps is None else gaps + gap
    return grouped.withColumn("gap_sum", gaps).select(
        *by, "rows", "unique_entities", "positive_cases", "score_sum", "square_sum", "gap_sum",
        F.explode(entries).alias("p"),
    ).select(
        *by, "p.threshold_policy", "rows", "unique_entities", "positive_cases", "score_sum", "square_sum",
        "gap_sum", "p.tp", "p.fp",
    )


def _rates(counts: DataFrame, by: Sequence[str], support: Support) -> DataFrame:
    """Metrics, suppression and reasons from group counts."""
    n, pos = F.col("rows"), F.col("positive_cases")
    neg = n - pos
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = pos - tp, neg - fp
    warned = tp + fp
    raw = {
        "outcome_prevalence": ratio(pos, n),
        "warning_rate": ratio(warned, n),
        "recall": ratio(tp, pos),
        "false_negative_rate": ratio(fn, pos),
        "specificity": ratio(tn, neg),
        "false_positive_rate": ratio(fp, neg),
        "precision": ratio(tp, warned),
        "negative_predictive_value": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (ratio(tp, pos) + ratio(tn, neg)) / 2,
        "mean_calibrated_output": ratio(F.col("score_sum"), n),
        "brier_score": ratio(F.col("square_sum"), n),
        "expected_calibration_error": ratio(F.col("gap_sum"), n),
    }
    few_pos = F.when(pos < support.positives, F.lit(f"positives<{support.positives}"))
    few_neg = F.when(neg < support.negatives, F.lit(f"negatives<{support.negatives}"))
    one_class = F.when((pos == 0) | (neg == 0), F.lit("calibration_requires_both_classes"))
    special: dict[str, Column] = {
        "recall": few_pos,
        "false_negative_rate": few_pos,
        "specificity": few_neg,
        "false_positive_rate": few_neg,
        "precision": F.when(
            warned < support.predicted_positives, F.lit(f"predicted_positives<{support.predicted_positives}")
        ),
        "brier_score": one_class,
        "expected_calibration_error": one_class,
        "balanced_accuracy": F.when(
            (pos < support.positives) | (neg < support.negatives), F.lit("class_support_insufficient")
        ),
    }
    few_rows = F.when(n < support.rows, F.lit(f"rows<{support.rows}"))
    few_entities = F.when(F.col("unique_entities") < support.entities, F.lit(f"students<{support.entities}"))
    undefined = {"f1", "balanced_accuracy", "mean_calibrated_output", "brier_score", "expected_calibration_error"}
    values, reasons = [], []
    for name, value in raw.items():
        parts = [few_rows, few_entities]
        if name in special:
            parts.append(special[name])
        parts.append(F.when(value.isNull(), F.lit("undefined" if name in undefined else "zero_denominator")))
        reason = F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ";")
        values.append(F.when(reason == "", value).alias(name))
        reasons.append(F.when(reason != "", reason).alias(f"reason_{name}"))
    return counts.select(
        *by,
        "threshold_policy",
        "rows",
        "unique_entities",
        "positive_cases",
        neg.alias("negative_cases"),
        warned.alias("warning_count"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        tn.alias("true_negatives"),
        *values,
        ((n >= support.rows) & (F.col("unique_entities") >= support.entities)).alias("supported"),
        *reasons,
    )


def _by_attribute(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("group")) for a in attributes]
    )
    return rows.withColumn("g", F.explode(entries)).select("*", "g.attribute", "g.group").drop("g", *attributes)


def group_metrics(
    rows: DataFrame,
    attributes: Sequence[str],
    policies: Sequence[str],
    support: Support = GROUP_SUPPORT,
    extra: Sequence[str] = (),
    score: str = "calibrated_output",
    label: str = "actual_label",
) -> DataFrame:
    """Metrics per day, policy, attribute and group."""
    by = ["observation_day", *extra, "attribute", "group"]
    return _rates(_counts(_by_attribute(rows, attributes), by, policies, score, label), by, support)


def intersection_metrics(
    rows: DataFrame,
    pairs: Sequence[tuple[str, str]],
    policy: str,
    support: Support = INTERSECTION_SUPPORT,
    score: str = "calibrated_output",
    label: str = "actual_label",
) -> DataFrame:
    """Metrics of two-attribute groups."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{a} x {b}").alias("intersection"),
                F.col(a).alias("left_group"),
                F.col(b).alias("right_group"),
            )
            for a, b in pairs
        ]
    )
    used = sorted({c for pair in pairs for c in pair})
    long = rows.withColumn("g", F.explode(entries)).select("*", "g.*").drop("g", *used)
    by = ["observation_day", "intersection", "left_group", "right_group"]
    out = _rates(_counts(long, by, [policy], score, label), by, support)
    return out.withColumn("group", F.concat_ws(" | ", "left_group", "right_group"))


def _with_reference(metrics: DataFrame, context: Sequence[str]) -> DataFrame:
    """Add the largest supported group of each context, ties by name."""
    place = F.min(
        F.when(F.col("supported"), F.struct((-F.col("rows")).alias("r"), F.col("group").alias("g")))
    ).over(W.partitionBy(*context))
    return metrics.withColumn("reference_group", place.getField("g"))


def reference_groups(metrics: DataFrame) -> DataFrame:
    context = ["observation_day", "threshold_policy", "attribute"]
    return _with_reference(metrics, context).select(*context, "reference_group").distinct()


def disparities(metrics: DataFrame) -> DataFrame:
    """Group minus reference, max-min ranges and equalized-odds gaps.

    Works on the small metric table; windows are per day, policy and attribute.
    """
    context = ["observation_day", "threshold_policy", "attribute"]
    refs = _with_reference(metrics, context)
    at_ref = F.col("group") == F.col("reference_group")
    same = W.partitionBy(*context)
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).alias("group_value"),
                F.col(f"ref_{m}").alias("reference_value"),
                F.col(f"reason_{m}").alias("suppression_reason"),
            )
            for m in DISPARITY_METRICS
        ]
    )
    with_ref = refs.select("*", *[F.max(F.when(at_ref, F.col(m))).over(same).alias(f"ref_{m}") for m in DISPARITY_METRICS])
    long = with_ref.select(*context, "group", "reference_group", F.explode(entries).alias("e")).select(
        *context, "group", "reference_group", "e.*"
    )
    own, base = F.col("group_value"), F.col("reference_value")
    gaps = long.select(
        F.lit("group_minus_reference").alias("analysis_type"),
        *context,
        "group",
        "reference_group",
        "metric",
        (own - base).alias("value"),
        "group_value",
        "reference_value",
        F.when((own > 0) & (base > 0), own / base).alias("max_min_ratio"),
        F.when(own.isNull(), F.col("suppression_reason")).alias("suppression_reason"),
        F.lit(None).cast("long").alias("supported_groups"),
    )
    many = F.count("group_value") > 1
    ranges = long.groupBy(*context, "reference_group", "metric").agg(
        F.when(many, F.max("group_value") - F.min("group_value")).alias("value"),
        F.when(many & (F.min("group_value") > 0), F.max("group_value") / F.min("group_value")).alias("max_min_ratio"),
        F.count("group_value").alias("supported_groups"),
    ).withColumn("analysis_type", F.lit("pairwise_range"))
    odds = with_ref.select(
        F.lit("equalized_odds_diagnostic").alias("analysis_type"),
        *context,
        "group",
        "reference_group",
        F.lit("max_abs_recall_or_fpr_difference").alias("metric"),
        F.when(
            F.col("recall").isNotNull() & F.col("ref_recall").isNotNull()
            & F.col("false_positive_rate").isNotNull() & F.col("ref_false_positive_rate").isNotNull(),
            F.greatest(
                F.abs(F.col("recall") - F.col("ref_recall")),
                F.abs(F.col("false_positive_rate") - F.col("ref_false_positive_rate")),
            ),
        ).alias("value"),
    )
    return gaps.unionByName(ranges, allowMissingColumns=True).unionByName(odds, allowMissingColumns=True)


def course_adjusted(
    rows: DataFrame, metrics: DataFrame, attributes: Sequence[str], policy: str, support: Support = GROUP_SUPPORT
) -> DataFrame:
    """Within-course gaps to the overall reference group, averaged two ways."""
    refs = reference_groups(metrics.where(F.col("threshold_policy") == policy)).drop("threshold_policy")
    course = group_metrics(rows, attributes, [policy], support, extra=UNIT_KEYS).join(
        refs, ["observation_day", "attribute"]
    )
    same = W.partitionBy("observation_day", *UNIT_KEYS, "attribute")
    at_ref = F.col("group") == F.col("reference_group")
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                (F.col(m) - F.max(F.when(at_ref, F.col(m))).over(same)).alias("difference"),
            )
            for m in ADJUSTED_METRICS
        ]
    )
    pairs = course.select(
        "observation_day", "attribute", "group", "reference_group",
        (F.col("rows") + F.max(F.when(at_ref, F.col("rows"))).over(same)).alias("weight"),
        entries.alias("es"),
    )
    long = (
        pairs.where(F.col("group") != F.col("reference_group"))
        .select("observation_day", "attribute", "group", "reference_group", "weight", F.explode("es").alias("e"))
        .select("observation_day", "attribute", "group", "reference_group", "weight", "e.*")
        .where("difference IS NOT NULL")
    )
    return long.groupBy("observation_day", "attribute", "group", "metric", "reference_group").agg(
        F.count(F.lit(1)).alias("contributing_presentations"),
        F.avg("difference").alias("equal_presentation_difference"),
        ratio(F.sum(F.col("difference") * F.col("weight")), F.sum("weight")).alias("row_weighted_difference"),
    )


def missingness(
    rows: DataFrame,
    attributes: Sequence[str],
    policy: str,
    support: Support = GROUP_SUPPORT,
    score: str = "calibrated_output",
    label: str = "actual_label",
) -> DataFrame:
    """Recorded against missing rows per attribute; both statuses always appear."""
    long = _by_attribute(rows, attributes).withColumn(
        "recording_status",
        F.when(F.col("group") == UNKNOWN_GROUP, F.lit("missing")).otherwise(F.lit("recorded")),
    )
    by = ["observation_day", "attribute", "recording_status"]
    counts = _counts(long, by, [policy], score, label)
    filler = (
        counts.select("observation_day", "attribute")
        .distinct()
        .withColumn("recording_status", F.explode(F.array(F.lit("missing"), F.lit("recorded"))))
        .withColumn("threshold_policy", F.lit(policy))
    )
    full = filler.join(counts, [*by, "threshold_policy"], "left").na.fill(0)
    whole = W.partitionBy("observation_day", "attribute")
    missing = F.sum(F.when(F.col("recording_status") == "missing", F.col("rows")).otherwise(0)).over(whole)
    out = _rates(full, by, support)
    return out.select(
        *by,
        missing.alias("missing_count"),
        ratio(missing, F.sum("rows").over(whole)).alias("missing_rate"),
        "rows",
        "unique_entities",
        "outcome_prevalence",
        "warning_rate",
        "recall",
        "false_positive_rate",
    )


def policy_sensitivity(gaps: DataFrame, primary: str) -> DataFrame:
    """Whether each gap keeps its direction under the other policies."""
    only = gaps.where(F.col("analysis_type") == "group_minus_reference")
    keys = ["observation_day", "attribute", "group", "metric"]
    a = only.where(F.col("threshold_policy") == primary).select(*keys, F.col("value").alias("primary_difference"))
    b = only.where(F.col("threshold_policy") != primary).select(
        *keys, F.col("threshold_policy").alias("sensitivity_policy"), F.col("value").alias("sensitivity_difference")
    )
    x, y = F.col("primary_difference"), F.col("sensitivity_difference")
    status = (
        F.when(x.isNull() | y.isNull(), "unsupported")
        .when(x * y < 0, "reverses")
        .when((x * y > 0) & (F.abs(y) > 2 * F.abs(x)), "same_direction_magnitude_more_than_doubled")
        .when(x * y > 0, "same_direction")
        .otherwise("zero_or_boundary")
    )
    return b.join(a, keys).select(*keys, "sensitivity_policy", "primary_difference", "sensitivity_difference", status.alias("direction_status"))
