"""Column contracts shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNIT_KEYS = ["unit", "period"]
ENTITY_KEYS = UNIT_KEYS + ["entity"]
DAILY_KEYS = ENTITY_KEYS + ["day"]
OBSERVATION_KEYS = ENTITY_KEYS + ["observation_day"]

# Output column names, category rules, labels and reasons that
# must match the published data contract.
CATEGORY_COLUMNS = {
    "homepage_clicks": ("homepage",),
    "forum_clicks": ("forumng",),
    "content_clicks": ("oucontent",),
    "quiz_clicks": ("quiz", "externalquiz"),
}
UNMATCHED_TYPE = "unknown"
DAILY_MEASURES = ["total_clicks", *CATEGORY_COLUMNS]
DAILY_COLUMNS = [
    *DAILY_KEYS,
    "total_clicks",
    "number_of_resources_visited",
    "number_of_activity_types_used",
    *CATEGORY_COLUMNS,
    "resource_ids",
    "activity_types",
]
ABSOLUTE_FEATURES = [
    "clicks_last_7_days",
    "active_days_last_7_days",
    "resources_last_7_days",
    "activity_types_last_7_days",
    "homepage_clicks_last_7_days",
    "forum_clicks_last_7_days",
    "content_clicks_last_7_days",
    "quiz_clicks_last_7_days",
    "days_since_last_activity",
]
CHANGE_FEATURES = [
    "historical_windows_available",
    "historical_average_clicks",
    "historical_standard_deviation_clicks",
    "click_difference_from_personal_average",
    "click_percentage_change_from_personal_average",
    "click_z_score",
    "historical_average_active_days",
    "active_days_difference_from_personal_average",
    "current_inactivity_gap",
    "longest_previous_inactivity_gap",
]
MODEL_FEATURES = ABSOLUTE_FEATURES + CHANGE_FEATURES
FEATURE_GROUPS = {
    "absolute": ABSOLUTE_FEATURES,
    "personal_change": CHANGE_FEATURES,
    "combined": MODEL_FEATURES,
}
TARGET = "future_inactivity"
AUDIT_COLUMNS = [
    "future_window_start_day",
    "future_window_end_day",
    "future_activity_days",
    "future_clicks",
    "official_withdrawal_day",
    "officially_withdrawn_by_observation_day",
    "officially_withdrawn_by_window_end",
    "final_result",
    "prediction_eligible",
    "prediction_ineligibility_reason",
    "window_complete",
    "baseline_ready",
    "outcome_eligible",
    "ineligibility_reason",
    "exclusion_reasons",
]
NON_NEGATIVE_COLUMNS = [
    "clicks_last_7_days",
    "active_days_last_7_days",
    "resources_last_7_days",
    "activity_types_last_7_days",
    "homepage_clicks_last_7_days",
    "forum_clicks_last_7_days",
    "content_clicks_last_7_days",
    "quiz_clicks_last_7_days",
    "historical_windows_available",
    "current_inactivity_gap",
    "longest_previous_inactivity_gap",
    "future_activity_days",
    "future_clicks",
]
RECORD_NULLABLE = [
    "historical_standard_deviation_clicks",
    "click_percentage_change_from_personal_average",
    "click_z_score",
    "current_inactivity_gap",
    "longest_previous_inactivity_gap",
]
RECORD_NON_NEGATIVE = [
    "historical_windows_available",
    "historical_average_clicks",
    "historical_standard_deviation_clicks",
    "historical_average_active_days",
    "current_inactivity_gap",
    "longest_previous_inactivity_gap",
]
RECORD_REFERENCE = "record_reference"
FORBIDDEN_FEATURES = set(AUDIT_COLUMNS) | set(OBSERVATION_KEYS) | {
    TARGET,
    "future_window_days",
    "exclusion_reason",
    "source_partition",
    "dataset_schema_version",
}
DATASET_SCHEMA_VERSION = "multicourse-modeling-v1"
RECORD_SCHEMA_VERSION = "reference-personal-change-v1"
UNKNOWN_GROUP = "Unknown / Not recorded"
OBSERVATION_DAYS = (14, 28, 42, 56)
ROLLING_DAYS = 7
FUTURE_DAYS = 14
MINIMUM_HISTORY = 7
CLIP = 1e-15
ABOVE_ALL_SCORES = 1.0000000000000002

_LONG_FEATURES = [c for c in ABSOLUTE_FEATURES] + [
    "historical_windows_available",
    "current_inactivity_gap",
    "longest_previous_inactivity_gap",
]

MODELING_SCHEMA = T.StructType(
    [T.StructField("unit", T.StringType()), T.StructField("period", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("entity", "observation_day")]
    + [
        T.StructField(c, T.LongType() if c in _LONG_FEATURES else T.DoubleType())
        for c in MODEL_FEATURES
    ]
    + [T.StructField(TARGET, T.BooleanType())]
    + [
        T.StructField(c, T.LongType())
        for c in (
            "future_window_start_day",
            "future_window_end_day",
            "future_activity_days",
            "future_clicks",
            "official_withdrawal_day",
        )
    ]
    + [
        T.StructField(c, T.BooleanType())
        for c in (
            "officially_withdrawn_by_observation_day",
            "officially_withdrawn_by_window_end",
        )
    ]
    + [T.StructField("final_result", T.StringType())]
    + [T.StructField(c, T.BooleanType()) for c in ("outcome_eligible", "prediction_eligible")]
    + [
        T.StructField(c, T.StringType())
        for c in ("exclusion_reason", "source_partition", "dataset_schema_version")
    ]
)


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    """Fail while the plan is built when a needed column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def check_feature_names(columns: list[str]) -> None:
    """Reject identifiers, targets, future and audit fields as model inputs."""
    bad = sorted(set(columns) & FORBIDDEN_FEATURES)
    if bad:
        raise ValueError(f"not allowed as model features: {bad}")
    if len(columns) != len(set(columns)):
        raise ValueError("duplicate model features")
