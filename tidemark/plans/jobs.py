"""Jobs that chain the operators from raw log to modeling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.baseline import personal_baseline
from tidemark.operators.daily import (
    conservation,
    daily_activity,
    daily_statistics,
    day_ranges,
    duplicate_key_counts,
    raw_statistics,
    unmatched_resources,
    with_activity_type,
)
from tidemark.operators.modeling import assemble
from tidemark.operators.outcomes import future_inactivity
from tidemark.operators.rolling import rolling_features
from tidemark.schema import DAILY_KEYS, ENTITY_KEYS, FUTURE_DAYS, MINIMUM_HISTORY, OBSERVATION_DAYS
from tidemark.sources.activity import course_days, replay_order
from tidemark.sources.tables import write_daily


def replay(log: DataFrame, resources: DataFrame, unit: str, period: str, start_day: int, end_day: int) -> DataFrame:
    """One course window in chronological order, with activity types."""
    rows = course_days(log, unit=unit, period=period, start_day=start_day, end_day=end_day)
    lookup = course_days(resources, unit=unit, period=period)
    return replay_order(with_activity_type(rows, lookup))


def build_daily_table(log: DataFrame, resources: DataFrame, root: str, mode: str = "errorifexists") -> dict[str, DataFrame]:
    """Enrich, aggregate and write the daily table; return its checks.

    A negative click value fails the write.
    """
    guarded = log.withColumn(
        "clicks",
        F.when(F.col("clicks") < 0, F.raise_error(F.lit("negative clicks")).cast("long")).otherwise(
            F.col("clicks")
        ),
    )
    daily = daily_activity(with_activity_type(guarded, resources))
    write_daily(daily, root, mode)
    return validate_daily_table(log, resources, log.sparkSession.read.parquet(root))


def validate_daily_table(log: DataFrame, resources: DataFrame, daily: DataFrame) -> dict[str, DataFrame]:
    """Statistics and checks of an existing daily table against its log."""
    return {
        "raw": raw_statistics(log),
        "unmatched": unmatched_resources(log, resources),
        "daily": daily_statistics(daily),
        "duplicates": duplicate_key_counts(daily, DAILY_KEYS),
        "ranges": day_ranges(daily),
        "conservation": conservation(log, daily),
    }


def course_features(
    daily: DataFrame,
    unit: str | None = None,
    period: str | None = None,
    entity: int | None = None,
    start_day: int | None = None,
    end_day: int | None = None,
    minimum_history: int = MINIMUM_HISTORY,
) -> DataFrame:
    """Rolling and baseline rows; history before ``start_day`` is kept."""
    picked = course_days(daily, unit, period, entity)
    return personal_baseline(rolling_features(picked, start_day, end_day), minimum_history)


def entity_outcomes(
    events: DataFrame,
    course_lengths: DataFrame,
    withdrawals: DataFrame | None,
    unit: str,
    period: str,
    entity: int,
    start_day: int,
    end_day: int,
    horizon: int = FUTURE_DAYS,
) -> DataFrame:
    """Outcome rows of one entity for every day of a range."""
    picked = course_days(events, unit, period, entity)
    daily = daily_activity(picked)
    roster = picked.select(*ENTITY_KEYS).distinct()
    return future_inactivity(daily, roster, range(start_day, end_day + 1), course_lengths, withdrawals, horizon)


def modeling_table(
    daily: DataFrame,
    roster: DataFrame,
    course_lengths: DataFrame,
    withdrawals: DataFrame | None,
    results: DataFrame | None,
    days: Sequence[int] = OBSERVATION_DAYS,
    horizon: int = FUTURE_DAYS,
    minimum_history: int = MINIMUM_HISTORY,
    unit: str | None = None,
    period: str | None = None,
) -> DataFrame:
    """Candidate rows of one course or of all courses at once."""
    picked = course_days(daily, unit, period)
    enrolled = course_days(roster, unit, period)
    features = personal_baseline(rolling_features(picked, 0, max(days)), minimum_history)
    outcomes = future_inactivity(picked, enrolled, days, course_lengths, withdrawals, horizon)
    return assemble(outcomes, features, results, days)
