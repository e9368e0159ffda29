"""Round trips through sinks, manifests and the build jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.audit import PRIMARY, labelled
from checks.features import _DAILY_KINDS, _FEATURE_KINDS
from checks.metrics import PRED, rd
from checks.registry import ORACLES, query, tidy, tidy_sql
from checks.tables import _RES
from checks.trajectories import DECISION, QUIET, START
from tidemark.operators import modeling as M
from tidemark.plans import audits, jobs
from tidemark.schema import CHANGE_FEATURES, ENTITY_KEYS, MODEL_FEATURES, OBSERVATION_KEYS, TARGET
from tidemark.session import scratch_folder
from tidemark.sources import manifest as Ma
from tidemark.sources import tables as T


def _raw_csv(spark, sf):
    """The log under the public files' column names, written as CSV."""
    path = scratch_folder(spark, "log-csv")
    A.raw_log(spark, sf).select(
        F.col("unit").alias("code_module"),
        F.col("period").alias("code_presentation"),
        F.col("entity").alias("id_student"),
        F.col("resource").alias("id_site"),
        F.col("day").alias("date"),
        F.col("clicks").alias("sum_click"),
    ).write.option("header", True).csv(path)
    return path


@query(
    "a01_typed_csv_scan",
    "WITH " + A.EV + "SELECT unit, period, entity, resource, CAST(day AS BIGINT) AS day, clicks FROM ev",
)
def csv_scan(spark, sf):
    return tidy(T.read_log(spark, _raw_csv(spark, sf)))


_MODEL_SEL = tidy_sql({"unit": "s", "period": "s", "entity": "i", "observation_day": "i", "future_inactivity": "b", **{c: "d" for c in MODEL_FEATURES}}, "modeling")


@query("a06_a08_modeling_csv_round_trip", "WITH " + A.MODELING + _MODEL_SEL)
def csv_round_trip(spark, sf):
    path = scratch_folder(spark, "modeling-csv")
    T.write_sorted(M.published(A.candidates(spark, sf)), path, "csv")
    return tidy(T.read_modeling_csv(spark, path))


@query(
    "a09_mixed_report_csv",
    "WITH " + A.DAILY + """SELECT unit, period, CAST(CAST(min(day) AS BIGINT) AS VARCHAR) AS minimum_day, NULL AS resource_ids, CAST(NULL AS VARCHAR) AS entity FROM daily GROUP BY ALL
UNION ALL SELECT unit, period, NULL, '[' || array_to_string(resource_ids, ',') || ']', CAST(entity AS VARCHAR) FROM daily""",
)
def mixed_reports(spark, sf):
    path = scratch_folder(spark, "reports")
    d = A.daily(spark, sf)
    first = d.groupBy("unit", "period").agg(F.min("day").alias("minimum_day"))
    T.write_reports([first, d.select("unit", "period", "entity", "resource_ids")], path)
    return spark.read.option("header", True).csv(path).select("unit", "period", "minimum_day", "resource_ids", "entity")


@query(
    "a10_json_lines_sink",
    "WITH " + A.ROLLING + "SELECT unit, period, entity, CAST(day AS BIGINT) AS day, CAST(clicks_last_7_days AS BIGINT) AS clicks_last_7_days, CAST(days_since_last_activity AS BIGINT) AS days_since_last_activity FROM rolling",
)
def json_lines(spark, sf):
    path = scratch_folder(spark, "messages")
    rows = A.rolling(spark, sf).select(*ENTITY_KEYS, "day", "clicks_last_7_days", "days_since_last_activity")
    T.write_messages(rows, path)
    return tidy(spark.read.schema(rows.schema).json(path))


@query("a12_file_manifest")
def file_manifest(spark, sf):
    out = Ma.file_manifest(spark, sf)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "sha256")


@query("a13_incremental_rebuild", "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily"))
def incremental_rebuild(spark, sf):
    """Rebuild only unit-periods whose fingerprint is unknown, then read all."""
    root = scratch_folder(spark, "daily")
    d = A.daily(spark, sf)
    T.write_daily(d.where("unit <> 'M1'").unionByName(d.where("unit = 'M1'").withColumn("total_clicks", F.lit(0).cast("long"))), root)
    current = Ma.partition_fingerprints(spark, root, "v1")
    stale = Ma.stale_partitions(current, current.where("unit <> 'M1'")).select("unit", "period")
    fresh = d.join(F.broadcast(stale), ["unit", "period"], "left_semi")
    Ma.rebuild_partitions(fresh.select(*[c for c in d.columns if c not in ("unit", "period")], "unit", "period"), root)
    return tidy(T.read_daily(spark, root))


@query(
    "a11_a14_scored_output",
    PRED.rstrip(", ") + f" SELECT unit, period, entity, observation_day, {rd('calibrated_output', 'score')} FROM pred",
)
def scored_output(spark, sf):
    path = scratch_folder(spark, "scores")
    rows = A.saved_predictions(spark, sf).select(*OBSERVATION_KEYS, F.col("calibrated_output").alias("score"))
    T.write_scores(rows, path)
    T.write_scores(rows, path, replace=True)
    return tidy(T.read_scoring_input(spark, path, "parquet", rows.schema))


@query(
    "b12_model_matrix",
    "WITH " + A.MODELING + "SELECT unit, period, entity, observation_day, "
    + ", ".join(rd(f, f) for f in CHANGE_FEATURES) + ", CAST(future_inactivity AS BIGINT) AS target FROM modeling",
)
def model_matrix(spark, sf):
    from tidemark.schema import check_feature_names

    check_feature_names(CHANGE_FEATURES)
    return tidy(
        A.modeling(spark, sf).select(
            *OBSERVATION_KEYS, *[F.col(f).cast("double").alias(f) for f in CHANGE_FEATURES], F.col(TARGET).cast("int").alias("target")
        )
    )


@query(
    "m02_build_daily_table",
    "WITH " + _RES + """, j AS (SELECT e.* REPLACE (coalesce(r.activity_type, 'unknown') AS activity_type) FROM ev e LEFT JOIN resources r ON r.unit = e.unit AND r.period = e.period AND r.resource = e.resource)
SELECT unit, period, entity, CAST(day AS BIGINT) AS day, CAST(sum(clicks) AS BIGINT) AS total_clicks, count(DISTINCT resource) AS number_of_resources_visited, count(DISTINCT activity_type) AS number_of_activity_types_used FROM j GROUP BY ALL""",
)
def build_daily(spark, sf):
    root = scratch_folder(spark, "daily")
    jobs.build_daily_table(A.raw_log(spark, sf), A.resources(spark, sf), root)
    return tidy(
        T.read_daily(spark, root).select(*ENTITY_KEYS, "day", "total_clicks", "number_of_resources_visited", "number_of_activity_types_used")
    )


@query(
    "m03_validate_daily_table",
    "WITH " + A.DAILY + """SELECT 'raw_rows' AS measure, count(*) AS value FROM ev UNION ALL SELECT 'daily_rows', count(*) FROM daily UNION ALL SELECT 'duplicate_keys', 0
UNION ALL SELECT 'clicks_before', CAST(sum(clicks) AS BIGINT) FROM ev UNION ALL SELECT 'clicks_after', CAST(sum(total_clicks) AS BIGINT) FROM daily UNION ALL SELECT 'unit_periods', count(DISTINCT (unit, period)) FROM daily""",
)
def validate_daily(spark, sf):
    out = jobs.validate_daily_table(A.events(spark, sf), A.resources(spark, sf), A.saved_daily(spark, sf))
    picks = [
        out["raw"].select(F.lit("raw_rows").alias("measure"), F.col("raw_rows").alias("value")),
        out["daily"].select(F.lit("daily_rows"), "daily_rows"),
        out["daily"].select(F.lit("unit_periods"), "unit_periods"),
        out["duplicates"].select(F.lit("duplicate_keys"), "duplicate_keys"),
        out["conservation"].select(F.lit("clicks_before"), "clicks_before"),
        out["conservation"].select(F.lit("clicks_after"), "clicks_after"),
    ]
    union = picks[0]
    for p in picks[1:]:
        union = union.union(p)
    return union


@query("m09_subgroup_audit", ORACLES["c17_d27_disparities"])
def subgroup_audit(spark, sf):
    out = audits.subgroup_audit(
        A.saved_predictions(spark, sf), labelled(spark, sf), A.ATTRIBUTES, A.PAIRS, PRIMARY, ["fixed", "recall_focused"]
    )
    return tidy(
        out["disparities"],
        ["analysis_type", "observation_day", "threshold_policy", "attribute", "group", "reference_group", "metric", "value", "max_min_ratio", "supported_groups"],
    )


@query("m10_stability_analysis", ORACLES["d37_course_trajectories"])
def stability_analysis(spark, sf):
    out = audits.stability_analysis(
        A.saved_predictions(spark, sf), A.saved_daily(spark, sf), A.lengths(spark, sf), A.OBS, DECISION, START, QUIET
    )
    return tidy(out["courses"])


@query("m12_monitoring_report", ORACLES["d43_feature_drift"])
def monitoring(spark, sf):
    from checks.resampling import _DF

    p = A.saved_predictions(spark, sf)
    out = audits.monitoring_report(
        p.where("observation_day = 19"), p.where("observation_day = 10"), _DF, "calibrated_output", "actual_label", aligned=True
    )
    return tidy(out["features"])
