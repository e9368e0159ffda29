"""Assembly, validation and reports of the modeling table."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, reason_list
from tidemark.schema import (
    ABSOLUTE_FEATURES,
    AUDIT_COLUMNS,
    CHANGE_FEATURES,
    DATASET_SCHEMA_VERSION,
    ENTITY_KEYS,
    MODEL_FEATURES,
    MODELING_SCHEMA,
    NON_NEGATIVE_COLUMNS,
    OBSERVATION_KEYS,
    TARGET,
    UNIT_KEYS,
    check_feature_names,
)


def merge_features(rolling: DataFrame, baseline: DataFrame) -> DataFrame:
    """Join separately built rolling and baseline rows on entity and day."""
    extra = [c for c in CHANGE_FEATURES + ["baseline_ready"] if c in baseline.columns]
    return rolling.join(baseline.select(*ENTITY_KEYS, "day", *extra), [*ENTITY_KEYS, "day"])


def assemble(
    outcomes: DataFrame,
    features: DataFrame,
    results: DataFrame | None,
    days: Sequence[int],
) -> DataFrame:
    """One candidate row per outcome, with its exclusion reasons.

    ``features`` holds rolling and baseline columns.  Rows that were built
    separately may leave either half null; ``window_complete`` and
    ``baseline_ready`` tell which half exists.
    """
    check_feature_names(MODEL_FEATURES)
    chosen = features.where(F.col("day").isin([int(d) for d in days])).select(
        *ENTITY_KEYS,
        F.col("day").alias("observation_day"),
        *MODEL_FEATURES,
        "window_complete",
        "baseline_ready",
    )
    joined = outcomes.join(chosen, OBSERVATION_KEYS, "left")
    if results is None:
        joined = joined.withColumn("final_result", F.lit(None).cast("string"))
    else:
        joined = joined.join(results.select(*ENTITY_KEYS, "final_result"), ENTITY_KEYS, "left")
    reasons = reason_list(
        F.when(F.col("window_complete").isNull(), F.lit("missing_rolling_features")).when(
            ~F.col("window_complete"), F.lit("partial_rolling_window")
        ),
        F.when(F.col("baseline_ready").isNull(), F.lit("missing_personal_baseline")).when(
            ~F.col("baseline_ready"), F.lit("baseline_not_ready")
        ),
        F.when(
            ~F.col("outcome_eligible"),
            F.coalesce("ineligibility_reason", F.lit("outcome_ineligible")),
        ),
        F.when(
            ~F.col("prediction_eligible"),
            F.coalesce("prediction_ineligibility_reason", F.lit("prediction_ineligible")),
        ),
        F.when(F.col(TARGET).isNull(), F.lit("missing_target")),
        F.when(
            F.col("officially_withdrawn_by_observation_day"),
            F.lit("withdrawn_by_observation_day"),
        ),
    )
    return joined.withColumn("exclusion_reasons", reasons).select(
        *OBSERVATION_KEYS, *MODEL_FEATURES, TARGET, *AUDIT_COLUMNS
    )


def included(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("exclusion_reasons").isNull())


def excluded(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("exclusion_reasons").isNotNull())


def published(candidates: DataFrame) -> DataFrame:
    """Model-ready rows in the declared column order and types."""
    rows = (
        included(candidates)
        .withColumnRenamed("exclusion_reasons", "exclusion_reason")
        .withColumn("source_partition", F.concat_ws("_", *UNIT_KEYS))
        .withColumn("dataset_schema_version", F.lit(DATASET_SCHEMA_VERSION))
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MODELING_SCHEMA])


def value_violations(candidates: DataFrame) -> DataFrame:
    """Counts of negative values per column that must not be negative."""
    return candidates.agg(
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in NON_NEGATIVE_COLUMNS]
    )


def integrity_violations(table: DataFrame) -> DataFrame:
    """Checks of the combined table in one aggregate row."""
    invalid = (
        ~F.coalesce(F.col("outcome_eligible"), F.lit(False))
        | ~F.coalesce(F.col("prediction_eligible"), F.lit(False))
        | F.coalesce(F.col("officially_withdrawn_by_observation_day"), F.lit(False))
        | F.col(TARGET).isNull()
        | (F.col("future_window_start_day") != F.col("observation_day") + 1)
        | (F.col("future_window_end_day") < F.col("future_window_start_day"))
    )
    negative = None
    for name in (
        "clicks_last_7_days",
        "active_days_last_7_days",
        "resources_last_7_days",
        "activity_types_last_7_days",
        "future_activity_days",
        "future_clicks",
    ):
        term = F.col(name) < 0
        negative = term if negative is None else negative | term
    return table.agg(
        F.count(F.lit(1)).alias("table_rows"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*OBSERVATION_KEYS))).alias(
            "duplicate_rows"
        ),
        F.count_if(F.coalesce(invalid, F.lit(True))).alias("invalid_rows"),
        F.count_if(negative).alias("negative_rows"),
        F.count_distinct("observation_day").alias("days"),
        F.count_distinct(TARGET).alias("classes"),
    )


def report_by(table: DataFrame, keys: list[str], few: int = 20) -> DataFrame:
    """Rows, entities, positives, prevalence, suitability and warnings."""
    positive = F.col("positive")
    out = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("table_rows"),
        F.count_distinct("entity").alias("entities"),
        F.count_if(F.col(TARGET)).alias("positive"),
    )
    both = (positive > 0) & (positive < F.col("table_rows"))
    return out.select(
        *keys,
        "table_rows",
        "entities",
        "positive",
        (F.col("table_rows") - positive).alias("negative"),
        ratio(positive, F.col("table_rows")).alias("prevalence"),
        F.when(both, F.lit("both_classes"))
        .otherwise(F.lit("single_class_descriptive_only"))
        .alias("training_suitability"),
        F.when(~both, F.lit("single_class"))
        .when(positive < few, F.lit("few_positive_rows"))
        .alias("warning"),
    )


def null_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one row per column."""
    counted = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in columns])
        ).alias("x")
    ).select("x.field", "x.nulls")


def exclusion_counts(candidates: DataFrame) -> DataFrame:
    return (
        excluded(candidates)
        .select(F.explode(F.split("exclusion_reasons", "\\|")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("excluded_rows"))
    )


def record_error(columns: Sequence[str], numbers: Collection[str] = ()) -> Column:
    """Text of the first broken scoring-record rule, or null.

    Missing, unknown and forbidden columns are found while the plan is built;
    this expression holds the per-row rules.  Text that is no number and booleans
    break the rule of their row only.  Columns in ``numbers`` are whole numbers or
    doubles already and are not read back from text, which costs more than scoring.
    """
    from tidemark.schema import RECORD_NON_NEGATIVE, RECORD_NULLABLE

    checks: Column | None = None
    for name in columns:
        c = F.col(name)
        rules: list[tuple[Column, str]] = []
        if name not in RECORD_NULLABLE:
            rules.append((c.isNull(), f"{name} may not be null"))
        as_double = c.cast("double") if name in numbers else c.cast("string").try_cast("double")
        rules.append((c.isNotNull() & as_double.isNull(), f"{name} must be numeric"))
        rules.append((F.isnan(as_double) | (F.abs(as_double) == float("inf")), f"{name} must be finite"))
        if name in RECORD_NON_NEGATIVE:
            rules.append((as_double < 0, f"{name} must be nonnegative"))
        if name == "historical_windows_available":
            rules.append((as_double != F.floor(as_double), f"{name} must be an integer"))
        if name == "historical_average_active_days":
            rules.append(((as_double < 0) | (as_double > 7), f"{name} must be between 0 and 7"))
        for condition, text in rules:
            hit = F.coalesce(condition, F.lit(False))
            checks = F.when(hit, F.lit(text)) if checks is None else checks.when(hit, F.lit(text))
    return checks.otherwise(F.lit(None).cast("string"))


def check_records(records: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Scoring records with an ``error`` column; valid rows have a null error."""
    from tidemark.schema import RECORD_REFERENCE

    allowed = set(CHANGE_FEATURES) | {RECORD_REFERENCE} | set(extra)
    present = set(records.columns)
    forbidden = sorted((present & (set(MODEL_FEATURES + AUDIT_COLUMNS + OBSERVATION_KEYS + [TARGET]) - set(CHANGE_FEATURES))) - set(extra))
    if forbidden:
        raise ValueError(f"Forbidden fields: {forbidden}")
    unknown = sorted(present - allowed)
    if unknown:
        raise ValueError(f"Unknown fields: {unknown}")
    missing = sorted(set(CHANGE_FEATURES) - present)
    if missing:
        raise ValueError(f"Missing fields: {missing}")
    kinds = {n: records.schema[n].dataType.typeName() for n in CHANGE_FEATURES}
    numbers = {n for n, kind in kinds.items() if kind in ("byte", "short", "integer", "long", "double")}
    checked = records.withColumn("error", record_error(CHANGE_FEATURES, numbers))
    text = [n for n, kind in kinds.items() if kind == "string"]
    return checked.withColumns({n: F.col(n).try_cast("double") for n in text}) if text else checked


def drop_absolute(table: DataFrame) -> DataFrame:
    """Keep only personal-change features next to the keys and target."""
    return table.drop(*ABSOLUTE_FEATURES)
