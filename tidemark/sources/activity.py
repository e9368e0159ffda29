"""Mapping of arbitrary tables onto the canonical activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DAILY_COLUMNS, UNIT_KEYS, require_columns


def as_activity_log(
    table: DataFrame,
    unit: Column,
    period: Column,
    entity: Column,
    day: Column,
    resource: Column,
    clicks: Column,
    activity_type: Column | None = None,
) -> DataFrame:
    """Project a table onto unit, period, entity, day, resource and clicks."""
    columns = [
        unit.cast("string").alias("unit"),
        period.cast("string").alias("period"),
        entity.cast("long").alias("entity"),
        day.cast("int").alias("day"),
        resource.cast("long").alias("resource"),
        clicks.cast("long").alias("clicks"),
    ]
    if activity_type is not None:
        columns.append(activity_type.cast("string").alias("activity_type"))
    return table.select(*columns)


def course_days(log: DataFrame, unit: str | None = None, period: str | None = None,
                entity: int | None = None, start_day: int | None = None,
                end_day: int | None = None) -> DataFrame:
    """Row filter by course, entity and inclusive day range.

    Every predicate is a plain comparison, so it reaches the scan.
    """
    if start_day is not None and end_day is not None and start_day > end_day:
        raise ValueError("start_day is after end_day")
    out = log
    if unit is not None:
        out = out.where(F.col("unit") == unit)
    if period is not None:
        out = out.where(F.col("period") == period)
    if entity is not None:
        out = out.where(F.col("entity") == entity)
    if start_day is not None:
        out = out.where(F.col("day") >= start_day)
    if end_day is not None:
        out = out.where(F.col("day") <= end_day)
    return out


def replay_order(log: DataFrame) -> DataFrame:
    """Chronological order: day, entity, resource."""
    return log.orderBy("day", "entity", "resource")


def check_daily_schema(daily: DataFrame) -> DataFrame:
    require_columns(daily, DAILY_COLUMNS, "daily table")
    return daily


def unit_periods(table: DataFrame, unit: str | None = None, period: str | None = None) -> DataFrame:
    """Distinct unit and period pairs, read from partition columns alone."""
    return course_days(table, unit=unit, period=period).select(*UNIT_KEYS).distinct()
