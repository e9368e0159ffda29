"""CSV and Parquet scans with declared schemas, and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import binary_target, flag_text, optional_int
from tidemark.schema import (
    DAILY_COLUMNS,
    ENTITY_KEYS,
    MODEL_FEATURES,
    OBSERVATION_KEYS,
    TARGET,
    UNIT_KEYS,
    require_columns,
)
from tidemark.sources.activity import course_days

# Column names of the public click-log files.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("id_student", T.LongType()),
        T.StructField("id_site", T.LongType()),
        T.StructField("date", T.IntegerType()),
        T.StructField("sum_click", T.LongType()),
    ]
)
RESOURCE_SCHEMA = T.StructType(
    [
        T.StructField("id_site", T.LongType()),
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("activity_type", T.StringType()),
        T.StructField("week_from", T.StringType()),
        T.StructField("week_to", T.StringType()),
    ]
)
REGISTRATION_SCHEMA = T.StructType(
    [
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("id_student", T.LongType()),
        T.StructField("date_registration", T.IntegerType()),
        T.StructField("date_unregistration", T.IntegerType()),
    ]
)
COURSE_SCHEMA = T.StructType(
    [
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("module_presentation_length", T.IntegerType()),
    ]
)
INFO_SCHEMA = T.StructType(
    [
        T.StructField("code_module", T.StringType()),
        T.StructField("code_presentation", T.StringType()),
        T.StructField("id_student", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("highest_education", T.StringType()),
        T.StructField("imd_band", T.StringType()),
        T.StructField("age_band", T.StringType()),
        T.StructField("num_of_prev_attempts", T.StringType()),
        T.StructField("studied_credits", T.StringType()),
        T.StructField("disability", T.StringType()),
        T.StructField("final_result", T.StringType()),
    ]
)
NAMES = {
    "code_module": "unit",
    "code_presentation": "period",
    "id_student": "entity",
    "id_site": "resource",
    "date": "day",
    "sum_click": "clicks",
    "module_presentation_length": "length_days",
    "date_unregistration": "withdrawal_day",
}


def _csv_header(spark: SparkSession, path: str) -> dict[str, str]:
    """Header names without a byte-order mark, and as the file has them."""
    header = spark.read.option("header", True).csv(path).columns
    return {h.lstrip("\ufeff"): h for h in header}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_token: str = "?") -> DataFrame:
    """Typed scan with a header; columns are matched by name, extras ignored.

    A UTF-8 byte-order mark before the header is accepted.  Values that do not
    parse fail the scan, and so does a file whose header differs from the first
    one's in names or order.
    """
    names = _csv_header(spark, path)
    by_name = {f.name: f for f in schema}
    missing = sorted(set(by_name) - set(names))
    if missing:
        raise ValueError(f"{path} lacks columns: {missing}")
    full = T.StructType(
        [T.StructField(raw, by_name[h].dataType if h in by_name else T.StringType()) for h, raw in names.items()]
    )
    rows = (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", null_token)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(*[F.col(f"`{names[n]}`").alias(NAMES.get(n, n)) for n in by_name])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LOG_SCHEMA)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RESOURCE_SCHEMA)


def read_withdrawals(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REGISTRATION_SCHEMA).select(*ENTITY_KEYS, "withdrawal_day")


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COURSE_SCHEMA)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, INFO_SCHEMA)


def read_daily(
    spark: SparkSession,
    root: str,
    unit: str | None = None,
    period: str | None = None,
    entity: int | None = None,
    start_day: int | None = None,
    end_day: int | None = None,
) -> DataFrame:
    """Partition-pruned scan of a daily table, with a column check first."""
    table = spark.read.parquet(root)
    require_columns(table, DAILY_COLUMNS, root)
    return course_days(table, unit, period, entity, start_day, end_day).select(*DAILY_COLUMNS)


def read_modeling(
    spark: SparkSession, path: str, days: Sequence[int] | None = None, features: Sequence[str] = tuple(MODEL_FEATURES)
) -> DataFrame:
    """Identifiers, target and chosen features of the requested days only."""
    table = spark.read.parquet(path)
    columns = [*OBSERVATION_KEYS, TARGET, *features]
    require_columns(table, columns, path)
    if days is not None:
        table = table.where(F.col("observation_day").isin(sorted({int(d) for d in days})))
    return table.select(*columns)


def read_modeling_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed re-load of a published modeling CSV; blanks are nulls."""
    rows = spark.read.option("header", True).option("nullValue", "").csv(path)
    require_columns(rows, [*OBSERVATION_KEYS, TARGET, *MODEL_FEATURES], path)
    return rows.select(
        "unit",
        "period",
        F.col("entity").cast("long").alias("entity"),
        F.col("observation_day").cast("long").alias("observation_day"),
        *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES],
        binary_target(F.col(TARGET)).alias(TARGET),
    )


def read_trajectories_csv(spark: SparkSession, path: str, days: Sequence[int]) -> DataFrame:
    """Typed re-load of a published trajectory CSV."""
    rows = spark.read.option("header", True).csv(path)
    text = {"unit", "period", "warning_sequence", "primary_category", "warning_timing"}
    flags = {c for c in rows.columns if c.endswith("_warning") or c in ("never_warned", "warning_escalation", "warning_deescalation", "persisted_to_end", "episode_eligible")}
    out = []
    for c in rows.columns:
        if c in text:
            out.append(F.col(c))
        elif c in flags:
            out.append(flag_text(F.col(c)).alias(c))
        elif c.endswith("_score"):
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(optional_int(F.col(c)).alias(c))
    return rows.select(*out)


def read_scoring_input(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """CSV or Parquet records for scoring.

    CSV values stay text, so that ``check_records`` can reject a row whose value
    is no number; it also turns the accepted ones into doubles.
    """
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        names = _csv_header(spark, path)
        missing = sorted({f.name for f in schema} - set(names))
        if missing:
            raise ValueError(f"{path} lacks columns: {missing}")
        text = T.StructType([T.StructField(raw, T.StringType()) for raw in names.values()])
        rows = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("nullValue", "").csv(path)
        return rows.select(*[F.col(f"`{names[f.name]}`").alias(f.name) for f in schema])
    raise ValueError("input must be csv or parquet")


def write_daily(daily: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """ZSTD Parquet partitioned by unit and period.

    Rows are spread inside each partition value by entity, so one large
    unit-period is written by many tasks.
    """
    writers = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.hash("entity"), F.lit(writers))
    (
        daily.repartition(*UNIT_KEYS, spread)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(*UNIT_KEYS)
        .parquet(root)
    )


def write_sorted(table: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Key-sorted sink; a range exchange sorts in parallel."""
    writer = table.orderBy(*OBSERVATION_KEYS).write.mode(mode)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("nullValue", "").csv(path)
    else:
        raise ValueError("kind must be parquet or csv")


def write_reports(tables: Sequence[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """CSV of several report tables with the union of their columns."""
    flat = []
    for t in tables:
        flat.append(
            t.select(
                *[
                    (F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)).alias(f.name)
                    for f in t.schema
                ]
            )
        )
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
    union.write.mode(mode).option("header", True).csv(path)


def as_messages(table: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return table.select(
        F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("message")
    )


def write_messages(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_scores(scored: DataFrame, path: str, kind: str = "parquet", replace: bool = False) -> None:
    """Scored output; an existing target is refused unless ``replace``."""
    writer = scored.write.mode("overwrite" if replace else "errorifexists")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        writer.option("header", True).csv(path)
