"""Raw events to daily activity, and checks of both tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import lookup_join
from tidemark.schema import (
    CATEGORY_COLUMNS,
    DAILY_COLUMNS,
    DAILY_KEYS,
    DAILY_MEASURES,
    UNIT_KEYS,
    UNMATCHED_TYPE,
)

RESOURCE_KEYS = UNIT_KEYS + ["resource"]


def with_activity_type(log: DataFrame, resources: DataFrame) -> DataFrame:
    """Attach each resource's activity type; misses become ``unknown``."""
    lookup = resources.select(*RESOURCE_KEYS, "activity_type")
    joined = lookup_join(log, lookup, RESOURCE_KEYS, spread="entity")
    return joined.withColumn(
        "activity_type", F.coalesce("activity_type", F.lit(UNMATCHED_TYPE))
    )


def unmatched_resources(log: DataFrame, resources: DataFrame) -> DataFrame:
    """Number of log rows whose resource is not in the lookup.

    The log is reduced to one counted row per resource before the anti-join.
    """
    per_resource = log.groupBy(*RESOURCE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    missing = per_resource.join(resources.select(*RESOURCE_KEYS), RESOURCE_KEYS, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("unmatched_site_ids"))


def daily_activity(events: DataFrame) -> DataFrame:
    """One row per entity and day: totals, exact distinct counts, sorted lists.

    Partial aggregation combines rows before the single shuffle; the distinct
    counts are the sizes of the collected sets.
    """
    grouped = events.groupBy(*DAILY_KEYS).agg(
        F.sum("clicks").cast("long").alias("total_clicks"),
        *[
            F.sum(F.when(F.col("activity_type").isin(*kinds), F.col("clicks")).otherwise(0))
            .cast("long")
            .alias(name)
            for name, kinds in CATEGORY_COLUMNS.items()
        ],
        F.array_sort(F.collect_set(F.col("resource").cast("long"))).alias("resource_ids"),
        F.array_sort(F.collect_set("activity_type")).alias("activity_types"),
    )
    return grouped.select(
        *DAILY_KEYS,
        "total_clicks",
        F.size("resource_ids").cast("long").alias("number_of_resources_visited"),
        F.size("activity_types").cast("long").alias("number_of_activity_types_used"),
        *CATEGORY_COLUMNS,
        "resource_ids",
        "activity_types",
    )


def raw_statistics(log: DataFrame) -> DataFrame:
    """Rows, clicks and negative click values of the raw log."""
    return log.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
        F.count_if(F.col("clicks") < 0).alias("negative_rows"),
    )


def daily_statistics(daily: DataFrame) -> DataFrame:
    """Row, key and click totals, negative rows and nulls per column."""
    negative = None
    for name in DAILY_MEASURES:
        term = F.col(name) < 0
        negative = term if negative is None else negative | term
    return daily.agg(
        F.count(F.lit(1)).alias("daily_rows"),
        F.count_distinct("unit").alias("units"),
        F.count_distinct(F.struct("unit", "period")).alias("unit_periods"),
        F.count_distinct("entity").alias("entities"),
        F.coalesce(F.sum("total_clicks"), F.lit(0)).cast("long").alias("total_clicks"),
        F.count_if(negative).alias("negative_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in DAILY_COLUMNS],
    )


def duplicate_key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicated keys and the rows beyond their first occurrence."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess_rows"),
    )


def day_ranges(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*UNIT_KEYS).agg(
        F.min("day").alias("minimum_day"), F.max("day").alias("maximum_day")
    )


def conservation(log: DataFrame, daily: DataFrame) -> DataFrame:
    """Clicks before and after aggregation, side by side in one row."""
    before = log.agg(F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("v")).withColumn(
        "side", F.lit("before")
    )
    after = daily.agg(
        F.coalesce(F.sum("total_clicks"), F.lit(0)).cast("long").alias("v")
    ).withColumn("side", F.lit("after"))
    both = before.unionByName(after).agg(
        F.max(F.when(F.col("side") == "before", F.col("v"))).alias("clicks_before"),
        F.max(F.when(F.col("side") == "after", F.col("v"))).alias("clicks_after"),
    )
    return both.withColumn("conserved", F.col("clicks_before") == F.col("clicks_after"))


def size_mismatches(daily: DataFrame) -> DataFrame:
    """Rows whose stored counts differ from their list sizes."""
    return daily.agg(
        F.count_if(F.size("resource_ids") != F.col("number_of_resources_visited")).alias(
            "resource_count_mismatches"
        ),
        F.count_if(F.size("activity_types") != F.col("number_of_activity_types_used")).alias(
            "type_count_mismatches"
        ),
    )
