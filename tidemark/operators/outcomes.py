"""Labels from a strictly future activity window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import lookup_join
from tidemark.schema import ENTITY_KEYS, FUTURE_DAYS, OBSERVATION_KEYS, UNIT_KEYS


def observation_grid(roster: DataFrame, days: Sequence[int]) -> DataFrame:
    """Every enrolled entity on every observation day."""
    if len(set(days)) != len(days):
        raise ValueError("observation days repeat")
    return roster.select(*ENTITY_KEYS).withColumn(
        "observation_day", F.explode(F.array(*[F.lit(int(d)) for d in days]))
    )


def future_activity(
    daily: DataFrame, days: Sequence[int], horizon: int = FUTURE_DAYS
) -> DataFrame:
    """Active days and clicks in ``[t + 1, t + horizon]`` for each requested day.

    Each daily row is assigned to the observation days it follows, then summed:
    no range join, and at most ``min(len(days), horizon)`` copies of a row.
    """
    wanted = F.array(*[F.lit(int(d)) for d in days])
    reached = F.filter(
        wanted, lambda t: (F.col("day") >= t + 1) & (F.col("day") <= t + horizon)
    )
    return (
        daily.select(*ENTITY_KEYS, "total_clicks", F.explode(reached).alias("observation_day"))
        .groupBy(*OBSERVATION_KEYS)
        .agg(
            F.count(F.lit(1)).alias("future_activity_days"),
            F.sum("total_clicks").cast("long").alias("future_clicks"),
        )
    )


def future_inactivity(
    daily: DataFrame,
    roster: DataFrame,
    days: Sequence[int],
    course_lengths: DataFrame,
    withdrawals: DataFrame | None = None,
    horizon: int = FUTURE_DAYS,
) -> DataFrame:
    """Label each observation; windows past the course end stay unlabelled."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    grid = observation_grid(roster, days)
    joined = lookup_join(
        grid, course_lengths.select(*UNIT_KEYS, "length_days"), UNIT_KEYS, spread="entity"
    )
    if withdrawals is None:
        joined = joined.withColumn("official_withdrawal_day", F.lit(None).cast("long"))
    else:
        joined = joined.join(
            withdrawals.select(
                *ENTITY_KEYS, F.col("withdrawal_day").cast("long").alias("official_withdrawal_day")
            ),
            ENTITY_KEYS,
            "left",
        )
    joined = joined.join(future_activity(daily, days, horizon), OBSERVATION_KEYS, "left")
    end = F.col("observation_day") + horizon
    reason = F.when(F.col("length_days").isNull(), F.lit("missing_course_metadata")).when(
        end > F.col("length_days") - 1, F.lit("future_window_exceeds_course_end")
    )
    left_by_now = F.coalesce(
        F.col("official_withdrawal_day") <= F.col("observation_day"), F.lit(False)
    )
    labelled = joined.withColumn("ineligibility_reason", reason)
    eligible = F.col("ineligibility_reason").isNull()
    active_days = F.when(eligible, F.coalesce("future_activity_days", F.lit(0)))
    return labelled.select(
        *OBSERVATION_KEYS,
        (F.col("observation_day") + 1).alias("future_window_start_day"),
        end.alias("future_window_end_day"),
        F.lit(horizon).alias("future_window_days"),
        active_days.cast("long").alias("future_activity_days"),
        F.when(eligible, F.coalesce("future_clicks", F.lit(0))).cast("long").alias("future_clicks"),
        (active_days == 0).alias("future_inactivity"),
        "official_withdrawal_day",
        left_by_now.alias("officially_withdrawn_by_observation_day"),
        F.coalesce(F.col("official_withdrawal_day") <= end, F.lit(False)).alias(
            "officially_withdrawn_by_window_end"
        ),
        eligible.alias("outcome_eligible"),
        "ineligibility_reason",
        (eligible & ~left_by_now).alias("prediction_eligible"),
        F.coalesce(
            F.col("ineligibility_reason"),
            F.when(left_by_now, F.lit("already_withdrawn_by_observation_day")),
        ).alias("prediction_ineligibility_reason"),
    )


def window_activity(intervals: DataFrame, daily: DataFrame, low: str, high: str) -> DataFrame:
    """Active days and clicks of each interval row in ``(low, high]`` days.

    Intervals are collected per entity and key first (one row each side), so
    the join is an equi-join on the entity and the day test runs inside it.
    """
    keys = [c for c in intervals.columns]
    matched = (
        intervals.join(daily.select(*ENTITY_KEYS, "day", "total_clicks"), ENTITY_KEYS)
        .where((F.col("day") > F.col(low)) & (F.col("day") <= F.col(high)))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("activity_days"),
            F.sum("total_clicks").cast("long").alias("clicks"),
        )
    )
    return intervals.join(matched, keys, "left").select(
        *keys,
        F.coalesce("activity_days", F.lit(0)).cast("long").alias("activity_days"),
        F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"),
    )
