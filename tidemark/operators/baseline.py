"""Personal baselines that look only at earlier rows of the same entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.schema import ENTITY_KEYS, MINIMUM_HISTORY


def personal_baseline(rolling: DataFrame, minimum_history: int = MINIMUM_HISTORY) -> DataFrame:
    """Compare each rolling row with the entity's earlier complete windows.

    The windows use the partitioning and order that the rolling features
    already have, so no further shuffle or sort is planned.
    """
    if minimum_history < 0:
        raise ValueError("minimum_history is negative")
    earlier = (
        W.partitionBy(*ENTITY_KEYS).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    )
    clicks = F.when(F.col("window_complete"), F.col("clicks_last_7_days")).cast("double")
    days = F.when(F.col("window_complete"), F.col("active_days_last_7_days")).cast("double")
    history = rolling.select(
        *rolling.columns,
        F.count(clicks).over(earlier).alias("historical_windows_available"),
        F.avg(clicks).over(earlier).alias("historical_average_clicks"),
        F.stddev_samp(clicks).over(earlier).alias("historical_standard_deviation_clicks"),
        F.avg(days).over(earlier).alias("historical_average_active_days"),
        F.max("days_since_last_activity").over(earlier).alias("longest_previous_inactivity_gap"),
    )
    change = F.col("clicks_last_7_days") - F.col("historical_average_clicks")
    return history.select(
        *rolling.columns,
        "historical_windows_available",
        (F.col("historical_windows_available") >= minimum_history).alias("baseline_ready"),
        "historical_average_clicks",
        "historical_standard_deviation_clicks",
        change.alias("click_difference_from_personal_average"),
        (ratio(change, F.col("historical_average_clicks")) * 100).alias(
            "click_percentage_change_from_personal_average"
        ),
        ratio(change, F.col("historical_standard_deviation_clicks")).alias("click_z_score"),
        "historical_average_active_days",
        (F.col("active_days_last_7_days") - F.col("historical_average_active_days")).alias(
            "active_days_difference_from_personal_average"
        ),
        F.col("days_since_last_activity").alias("current_inactivity_gap"),
        "longest_previous_inactivity_gap",
    )
