"""Sources, daily activity, rolling features, labels and the modeling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.registry import query, r6, tidy, tidy_sql
from tidemark.schema import CATEGORY_COLUMNS, MODEL_FEATURES, ABSOLUTE_FEATURES, CHANGE_FEATURES

_DAILY_KINDS = {
    "unit": "s", "period": "s", "entity": "i", "day": "i", "total_clicks": "i",
    "number_of_resources_visited": "i", "number_of_activity_types_used": "i",
    **{c: "i" for c in CATEGORY_COLUMNS}, "resource_ids": "a", "activity_types": "a",
}
_LONGS = set(ABSOLUTE_FEATURES) | {"historical_windows_available", "current_inactivity_gap", "longest_previous_inactivity_gap"}
_FEATURE_KINDS = {c: "i" if c in _LONGS else "d" for c in MODEL_FEATURES}
_SERIES = {"unit": "s", "period": "s", "entity": "i", "day": "i", "window_complete": "b"}
_ROLL_KINDS = {**_SERIES, **{c: "i" for c in ABSOLUTE_FEATURES}}
_BASE_KINDS = {**_SERIES, "baseline_ready": "b", **_FEATURE_KINDS}


@query("d01_daily_activity", "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily"))
def daily_activity(spark, sf):
    return tidy(A.daily(spark, sf))


@query("e01_e05_rolling_features", "WITH " + A.ROLLING + tidy_sql(_ROLL_KINDS, "rolling"))
def rolling(spark, sf):
    return tidy(A.rolling(spark, sf))


@query(
    "e01_rolling_default_bounds",
    "WITH " + A.rolling_sql(start="first_day", end="final_day") + tidy_sql(_ROLL_KINDS, "rolling"),
)
def rolling_default(spark, sf):
    from tidemark.operators.rolling import rolling_features

    return tidy(rolling_features(A.daily(spark, sf)))


@query("e06_e07_personal_baseline", "WITH " + A.FEATURES + tidy_sql(_BASE_KINDS, "features"))
def baseline(spark, sf):
    return tidy(A.features(spark, sf))


@query("e06_e07_baseline_with_prestart_history", "WITH " + A.FEATURES_SHIFTED + tidy_sql(_BASE_KINDS, "features"))
def baseline_shifted(spark, sf):
    return tidy(A.features(spark, sf, shift=-4))
