"""Late rows of a stream as a result of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_late(stream: DataFrame, folder: str, time_col: str, delay: str) -> DataFrame:
    """Process all available input and return every row so far with batch_id, watermark and late.

    A row is late if its time is behind the watermark: the latest time of all
    earlier batches less ``delay``.  Rows of the first batch and rows without a
    time are not late.  Nothing is dropped.  ``folder`` keeps rows, the latest time
    of each batch and the stream's progress, so a later call, or a restart after a
    loss, goes on where the last one ended; a replayed batch replaces its own rows.
    Columns batch_id, watermark and late of the stream are refused.
    """
    taken = {"batch_id", "watermark", "late"} & set(stream.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    spark = stream.sparkSession
    marks_schema = "batch_id long, latest timestamp"
    # both folders exist before the first batch
    spark.createDataFrame([], marks_schema).write.mode("append").parquet(f"{folder}/marks")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        marks = session.read.schema(marks_schema).option("recursiveFileLookup", "true").parquet(f"{folder}/marks")
        latest = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest").alias("latest")).first().latest
        watermark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        rows = batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), "watermark": watermark})
        rows = rows.withColumn("late", F.coalesce(F.col(time_col) < F.col("watermark"), F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{batch_id}")
        back = session.read.schema(rows.schema).parquet(f"{folder}/rows/{batch_id}")
        mark = back.groupBy("batch_id").agg(F.max(time_col).alias("latest"))
        mark.write.mode("overwrite").parquet(f"{folder}/marks/{batch_id}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = stream.withColumns(
        {"batch_id": F.lit(0).cast("long"), "watermark": F.lit(None).cast("timestamp"), "late": F.lit(False)}
    ).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def late_counts(rows: DataFrame, time_col: str) -> DataFrame:
    """Rows and late rows of each batch, and how far the latest of them came behind (seconds)."""
    behind = F.when(F.col("late"), F.unix_timestamp("watermark") - F.unix_timestamp(time_col))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"), F.max(behind).alias("most_seconds_behind")
    )
