"""Streaming sources, windows and drains that equal their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import CATEGORY_COLUMNS, ENTITY_KEYS
from tidemark.session import scratch_folder


def replay_source(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_trigger: int | None = 1,
    pattern: str = "*.parquet",
) -> DataFrame:
    """Parquet files of a folder in arrival order, a few per micro-batch; None: all there are in one."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def closable(events: DataFrame, time_col: str = "event_time") -> tuple[DataFrame, Callable[[], None]]:
    """``events`` with a way to end a finite stream, for :func:`drain`.

    Calling the second result adds one row that holds nothing but a time far
    ahead.  It moves the watermark past every open window and session, which are
    then emitted; its own window stays open, so it never shows.  Call it only once
    all input has been processed: what arrives later is late.
    """
    spark, schema = events.sparkSession, events.schema
    folder = scratch_folder(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(folder)

    def close() -> None:
        end = F.lit("3000-01-01 00:00:00").cast(schema[time_col].dataType)
        row = spark.range(1).select(*[(end if f.name == time_col else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
        row.write.mode("append").parquet(folder)

    return events.unionByName(spark.readStream.schema(schema).parquet(folder)), close


def drain(stream: DataFrame, name: str, mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Process all available input into a table and read it back; ``close`` also emits what is still open."""
    spark = stream.sparkSession
    out = scratch_folder(spark, name)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/progress")
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if close is not None:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_daily(events: DataFrame, origin: str, delay: str = "1 hour") -> DataFrame:
    """Daily activity in one-day tumbling windows; exact distinct via sets.

    ``events`` has the entity keys, ``event_time``, ``resource``,
    ``activity_type`` and ``clicks``.  A day is emitted once the watermark has
    passed it; later rows for it are dropped.
    """
    grouped = (
        events.withWatermark("event_time", delay)
        .groupBy(*ENTITY_KEYS, F.window("event_time", "1 day").alias("w"))
        .agg(
            F.sum("clicks").cast("long").alias("total_clicks"),
            *[
                F.sum(F.when(F.col("activity_type").isin(*kinds), F.col("clicks")).otherwise(0))
                .cast("long")
                .alias(n)
                for n, kinds in CATEGORY_COLUMNS.items()
            ],
            F.array_sort(F.collect_set(F.col("resource").cast("long"))).alias("resource_ids"),
            F.array_sort(F.collect_set("activity_type")).alias("activity_types"),
        )
    )
    return grouped.select(
        *ENTITY_KEYS,
        F.datediff(F.to_date("w.start"), F.lit(origin).cast("date")).alias("day"),
        "total_clicks",
        F.size("resource_ids").cast("long").alias("number_of_resources_visited"),
        F.size("activity_types").cast("long").alias("number_of_activity_types_used"),
        *CATEGORY_COLUMNS,
        "resource_ids",
        "activity_types",
    )


def stream_trailing(events: DataFrame, origin: str, days: int = 7, delay: str = "1 hour") -> DataFrame:
    """Trailing totals in sliding windows; only closed windows are emitted."""
    grouped = (
        events.withWatermark("event_time", delay)
        .groupBy(*ENTITY_KEYS, F.window("event_time", f"{days} days", "1 day").alias("w"))
        .agg(
            F.sum("clicks").cast("long").alias("clicks_last_7_days"),
            F.size(F.collect_set(F.to_date("event_time"))).cast("long").alias("active_days_last_7_days"),
            *[
                F.sum(F.when(F.col("activity_type").isin(*kinds), F.col("clicks")).otherwise(0))
                .cast("long")
                .alias(f"{n}_last_7_days")
                for n, kinds in CATEGORY_COLUMNS.items()
            ],
        )
    )
    return grouped.select(
        *ENTITY_KEYS,
        (F.datediff(F.to_date("w.end"), F.lit(origin).cast("date")) - 1).alias("day"),
        "clicks_last_7_days",
        "active_days_last_7_days",
        *[f"{n}_last_7_days" for n in CATEGORY_COLUMNS],
    )


def stream_sessions(events: DataFrame, origin: str, quiet_days: int = 14, delay: str = "1 hour") -> DataFrame:
    """Activity sessions split by ``quiet_days`` or more whole quiet days.

    Stamps are cut to midnight, so touching sessions of neighbouring days merge
    and the day after ``last_day`` starts a quiet run.
    """
    stamped = events.withColumn("day_time", F.date_trunc("day", "event_time")).withWatermark("day_time", delay)
    sessions = stamped.groupBy(*ENTITY_KEYS, F.session_window("day_time", f"{quiet_days} days").alias("s")).agg(
        F.sum("clicks").cast("long").alias("clicks")
    )
    first = F.datediff(F.to_date("s.start"), F.lit(origin).cast("date"))
    last = F.datediff(F.to_date("s.end"), F.lit(origin).cast("date")) - quiet_days
    return sessions.select(*ENTITY_KEYS, first.alias("first_day"), last.alias("last_day"), "clicks")


def first_alerts(alerts: DataFrame, cooldown: str = "14 days") -> DataFrame:
    """First alert per entity within the watermark; later ones are duplicates."""
    return alerts.withWatermark("event_time", cooldown).dropDuplicatesWithinWatermark(ENTITY_KEYS)


def micro_batch_report(stream: DataFrame, report, name: str) -> DataFrame:
    """Apply ``report(batch_df)`` to each micro-batch and append its rows.

    The batch id is part of the written path, so a replayed batch replaces its
    own output instead of adding to it.
    """
    spark = stream.sparkSession
    out = scratch_folder(spark, name)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = report(batch).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data").drop("batch")
