"""Dense daily calendar with trailing-window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schema import CATEGORY_COLUMNS, ENTITY_KEYS, ROLLING_DAYS

_KINDS = {"resource": "resource_ids", "type": "activity_types"}


def rolling_features(
    daily: DataFrame,
    start_day: int | None = None,
    end_day: int | None = None,
    window_days: int = ROLLING_DAYS,
) -> DataFrame:
    """One row per entity and calendar day with trailing-window totals.

    Distinct resources in a window are counted without listing them: an item
    enters the windows on a day it is seen after at least ``window_days`` days
    unseen, and leaves them ``window_days`` days after a sighting that none
    followed in time.  Each active day therefore stores two numbers per kind,
    and the distinct count is a difference of their running totals.  Rows are
    never multiplied by their items.  Everything after the first exchange
    shares the same partitioning by entity.
    """
    if start_day is not None and end_day is not None and start_day > end_day:
        raise ValueError("start_day is after end_day")
    by_day = W.partitionBy(*ENTITY_KEYS).orderBy("day")
    counters = [f"{kind}_{way}" for kind in _KINDS for way in ("enters", "leaves")]

    def unseen(items: str, low: int, high: int):
        """How many of the day's items occur on none of the days ``low`` to ``high`` from it."""
        others = F.flatten(F.collect_list(items).over(by_day.rangeBetween(low, high)))
        return F.size(F.array_except(items, others)).cast("long")

    near = window_days - 1
    measures = ["total_clicks", *CATEGORY_COLUMNS]
    active = (
        daily.repartition(*ENTITY_KEYS)
        .select(*ENTITY_KEYS, "day", *measures, *_KINDS.values())
        .select(
            *ENTITY_KEYS,
            "day",
            *measures,
            F.lead("day").over(by_day).alias("next_day"),
            F.lag("day").over(by_day).alias("earlier_day"),
            *[
                (unseen(items, low, high) if near else F.size(F.array_distinct(items)).cast("long")).alias(f"{kind}_{way}")
                for kind, items in _KINDS.items()
                for way, low, high in (("enters", -near, -1), ("leaves", 1, near))
            ],
        )
    )
    opening = F.col("day") if start_day is None else F.least(F.lit(start_day), F.col("day"))
    first = F.when(F.col("earlier_day").isNull(), opening).otherwise(F.col("day"))
    if end_day is None:
        last = F.coalesce(F.col("next_day") - 1, F.col("day"))
    else:
        last = F.least(F.coalesce(F.col("next_day") - 1, F.lit(end_day)), F.lit(end_day))
    calendar = (
        active.withColumn("from_day", first.cast("int"))
        .withColumn("to_day", last.cast("int"))
        .where("from_day <= to_day")
        .withColumn("seen_day", F.col("day"))
        .withColumn("calendar_day", F.explode(F.sequence("from_day", "to_day")))
    )
    is_active = F.col("calendar_day") == F.col("seen_day")
    dense = calendar.select(
        *ENTITY_KEYS,
        F.col("calendar_day").alias("day"),
        is_active.cast("long").alias("active"),
        *[F.when(is_active, F.col(c)).otherwise(0).alias(c) for c in measures + counters],
        F.when(
            F.col("calendar_day") >= F.col("seen_day"), F.col("calendar_day") - F.col("seen_day")
        )
        .cast("long")
        .alias("days_since_last_activity"),
    )
    series = W.partitionBy(*ENTITY_KEYS).orderBy("day")
    trailing = series.rowsBetween(-(window_days - 1), 0)

    upto = series.rowsBetween(W.unboundedPreceding, 0)
    gone = series.rowsBetween(W.unboundedPreceding, -window_days)

    def distinct(kind: str):
        left = F.coalesce(F.sum(f"{kind}_leaves").over(gone), F.lit(0))
        return (F.sum(f"{kind}_enters").over(upto) - left).cast("long")

    opened = (
        F.min(F.when(F.col("active") == 1, F.col("day"))).over(
            series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        )
        if start_day is None
        else F.lit(start_day)
    )
    rolled = dense.select(
        *ENTITY_KEYS,
        "day",
        opened.alias("output_start"),
        F.sum("total_clicks").over(trailing).cast("long").alias("clicks_last_7_days"),
        F.sum("active").over(trailing).cast("long").alias("active_days_last_7_days"),
        distinct("resource").alias("resources_last_7_days"),
        distinct("type").alias("activity_types_last_7_days"),
        *[
            F.sum(c).over(trailing).cast("long").alias(f"{c}_last_7_days")
            for c in CATEGORY_COLUMNS
        ],
        "days_since_last_activity",
    )
    return rolled.where(F.col("day") >= F.col("output_start")).select(
        *ENTITY_KEYS,
        "day",
        (F.col("day") >= F.col("output_start") + (window_days - 1)).alias("window_complete"),
        "clicks_last_7_days",
        "active_days_last_7_days",
        "resources_last_7_days",
        "activity_types_last_7_days",
        *[f"{c}_last_7_days" for c in CATEGORY_COLUMNS],
        "days_since_last_activity",
    )
