"""Scans, filters, joins, validation and the modeling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.features import _BASE_KINDS, _DAILY_KINDS, _FEATURE_KINDS, _ROLL_KINDS
from checks.registry import query, r6, tidy, tidy_sql
from tidemark.functions import joins, scalars
from tidemark.operators import daily as D
from tidemark.operators import modeling as M
from tidemark.operators import outcomes as O
from tidemark.operators import parity as P
from tidemark.operators.baseline import personal_baseline
from tidemark.operators.rolling import rolling_features
from tidemark.schema import DAILY_COLUMNS, MODEL_FEATURES, NON_NEGATIVE_COLUMNS, OBSERVATION_KEYS, ENTITY_KEYS
from tidemark.session import scratch_folder
from tidemark.sources import activity as S
from tidemark.sources import tables as T

_EV_KINDS = {"unit": "s", "period": "s", "entity": "i", "day": "i", "resource": "i", "clicks": "i", "activity_type": "s"}
_OUT_KINDS = {
    "unit": "s", "period": "s", "entity": "i", "observation_day": "i", "future_window_start_day": "i",
    "future_window_end_day": "i", "future_activity_days": "i", "future_clicks": "i", "future_inactivity": "b",
    "official_withdrawal_day": "i", "officially_withdrawn_by_observation_day": "b",
    "officially_withdrawn_by_window_end": "b", "outcome_eligible": "b", "ineligibility_reason": "s",
    "prediction_eligible": "b", "prediction_ineligibility_reason": "s",
}
_MODEL_KINDS = {**_OUT_KINDS, **_FEATURE_KINDS, "window_complete": "b", "baseline_ready": "b", "final_result": "s", "exclusion_reasons": "s"}

_RES = A.EV + """,
resources AS (SELECT unit, period, resource, min(activity_type) AS activity_type FROM ev WHERE resource % 7 <> 0 GROUP BY ALL)
"""


# ---------------------------------------------------------------- A: scans


@query(
    "a02_null_tokens",
    "WITH " + A.ROSTER + A.INFO
    + "SELECT unit, period, entity, CASE WHEN trim(segment) NOT IN ('', '?') THEN trim(segment) END AS segment, "
    "CASE WHEN trim(region) NOT IN ('', '?') THEN trim(region) END AS region FROM info",
)
def null_tokens(spark, sf):
    return A.info(spark, sf).select(
        *ENTITY_KEYS, *[scalars.recorded(F.col(c)).alias(c) for c in ("segment", "region")]
    )


@query(
    "a03_last_row_wins",
    "SELECT user_id AS entity, max_by(event_type, event_id) AS activity_type FROM events GROUP BY ALL",
)
def last_row(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("activity_type"), "event_id"
    )
    return joins.last_row_wins(e, ["entity"], "event_id").select("entity", "activity_type")


def _written_daily(spark, sf):
    root = scratch_folder(spark, "daily")
    T.write_daily(A.daily(spark, sf), root)
    return root


@query(
    "a04_a07_partition_scan",
    "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily WHERE unit = 'M1' AND period = 'P0' AND day BETWEEN 5 AND 20"),
)
def partition_scan(spark, sf):
    return tidy(T.read_daily(spark, _written_daily(spark, sf), unit="M1", period="P0", start_day=5, end_day=20))


@query("a05_unit_periods", "WITH " + A.EV + "SELECT DISTINCT unit, period FROM ev WHERE unit = 'M2'")
def unit_periods(spark, sf):
    return S.unit_periods(spark.read.parquet(_written_daily(spark, sf)), unit="M2")


@query(
    "a06_projected_day_load",
    "WITH " + A.MODELING
    + tidy_sql(
        {"unit": "s", "period": "s", "entity": "i", "observation_day": "i", "future_inactivity": "b", **_FEATURE_KINDS},
        "modeling WHERE observation_day IN (13, 19)",
    ),
)
def projected_load(spark, sf):
    path = scratch_folder(spark, "modeling")
    T.write_sorted(M.published(A.candidates(spark, sf)), path)
    return tidy(T.read_modeling(spark, path, [13, 19]))


@query(
    "a10_json_messages",
    "WITH " + A.ROLLING
    + """SELECT '{"unit":"' || unit || '","period":"' || period || '","entity":' || entity || ',"day":' || day
      || ',"days_since_last_activity":' || coalesce(CAST(days_since_last_activity AS VARCHAR), 'null') || '}' AS message FROM rolling""",
)
def messages(spark, sf):
    return T.as_messages(A.rolling(spark, sf).select(*ENTITY_KEYS, "day", "days_since_last_activity"))


# ---------------------------------------------------------------- B: filters and validation


@query(
    "b01_course_day_range",
    "WITH " + A.EV + tidy_sql(_EV_KINDS, "ev WHERE unit = 'M0' AND period = 'P1' AND day BETWEEN 3 AND 12"),
)
def course_range(spark, sf):
    return tidy(S.course_days(A.events(spark, sf), unit="M0", period="P1", start_day=3, end_day=12))


@query("b02_one_entity_features", "WITH " + A.FEATURES + tidy_sql(_BASE_KINDS, "features WHERE entity = 7"))
def one_entity(spark, sf):
    picked = S.course_days(A.daily(spark, sf), entity=7)
    return tidy(personal_baseline(rolling_features(picked, 0, A.LAST_DAY), A.HISTORY))


@query(
    "b03_fixed_rule",
    "WITH " + A.MODELING
    + """SELECT unit, period, entity, observation_day, CAST(coalesce(current_inactivity_gap >= 7, false)
      OR coalesce(click_percentage_change_from_personal_average <= -50 AND active_days_last_7_days <= 2, false) AS BIGINT) AS warned
      FROM modeling""",
)
def fixed_rule(spark, sf):
    warned = scalars.fixed_rule(
        F.col("current_inactivity_gap"),
        F.col("click_percentage_change_from_personal_average"),
        F.col("active_days_last_7_days"),
    )
    return A.modeling(spark, sf).select(*OBSERVATION_KEYS, warned.cast("long").alias("warned"))


@query(
    "b04_threshold_decision",
    "WITH " + A.PREDICTIONS
    + "SELECT unit, period, entity, observation_day, round(calibrated_output, 6) + 0.0 AS score, CAST(fixed_prediction AS BIGINT) AS decision FROM pred",
)
def threshold_decision(spark, sf):
    p = A.predictions(spark, sf)
    return p.select(
        *OBSERVATION_KEYS,
        r6("calibrated_output").alias("score"),
        scalars.decision(F.col("calibrated_output"), 0.5).cast("long").alias("decision"),
    )


@query(
    "b06_nullable_ratio",
    "WITH " + A.DAILY
    + "SELECT unit, period, entity, day, round(CASE WHEN forum_clicks <> 0 THEN quiz_clicks / forum_clicks END, 6) + 0.0 AS share FROM daily",
)
def nullable_ratio(spark, sf):
    return A.daily(spark, sf).select(
        *ENTITY_KEYS, "day", r6(scalars.ratio(F.col("quiz_clicks"), F.col("forum_clicks"))).alias("share")
    )


@query("b07_excluded_rows", "WITH " + A.MODELING + tidy_sql(_MODEL_KINDS, "cand WHERE exclusion_reasons IS NOT NULL"))
def excluded(spark, sf):
    return tidy(M.excluded(A.candidates(spark, sf)), list(_MODEL_KINDS))


@query(
    "b08_value_violations",
    "WITH " + A.MODELING + "SELECT "
    + ", ".join(f"CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS negative_{c}" for c in NON_NEGATIVE_COLUMNS)
    + " FROM cand",
)
def violations(spark, sf):
    return M.value_violations(A.candidates(spark, sf))


@query(
    "b09_parse_target",
    "SELECT doc_id, CAST(quality AS BIGINT) AS target FROM labels",
)
def parse_target(spark, sf):
    text = F.when(F.col("quality") == 1, F.lit(" True ")).otherwise(F.lit("FALSE"))
    return A.table(spark, sf, "labels").select(
        "doc_id", scalars.binary_target(text).cast("long").alias("target")
    )


_RECORD_SQL = (
    "WITH " + A.FEATURES + """,
rec AS (SELECT unit, period, entity, day, historical_windows_available, historical_average_clicks,
  click_difference_from_personal_average, historical_average_active_days,
  active_days_difference_from_personal_average FROM features)
SELECT unit, period, entity, CAST(day AS BIGINT) AS day,
  CASE WHEN historical_average_clicks IS NULL THEN 'historical_average_clicks may not be null'
       WHEN click_difference_from_personal_average IS NULL THEN 'click_difference_from_personal_average may not be null'
       WHEN historical_average_active_days IS NULL THEN 'historical_average_active_days may not be null'
       WHEN historical_average_active_days > 7 OR historical_average_active_days < 0 THEN 'historical_average_active_days must be between 0 and 7'
       WHEN active_days_difference_from_personal_average IS NULL THEN 'active_days_difference_from_personal_average may not be null' END AS error
FROM rec"""
)


@query("b10_record_contract", _RECORD_SQL)
def record_contract(spark, sf):
    from tidemark.schema import CHANGE_FEATURES

    records = A.features(spark, sf).select(*ENTITY_KEYS, "day", *CHANGE_FEATURES)
    return M.check_records(records, extra=[*ENTITY_KEYS, "day"]).select(
        *ENTITY_KEYS, F.col("day").cast("long").alias("day"), "error"
    )


@query(
    "b13_published_labels",
    "WITH " + A.MODELING
    + "SELECT unit, period, entity, observation_day, unit || '_' || period AS source_partition, 'multicourse-modeling-v1' AS dataset_schema_version FROM modeling",
)
def published_labels(spark, sf):
    return M.published(A.candidates(spark, sf)).select(
        *OBSERVATION_KEYS, "source_partition", "dataset_schema_version"
    )


@query(
    "b14_display_rounding",
    "WITH " + A.FEATURES
    + "SELECT unit, period, entity, CAST(day AS BIGINT) AS day, round(historical_average_clicks, 4) + 0.0 AS shown FROM features",
)
def display_rounding(spark, sf):
    return A.features(spark, sf).select(
        *ENTITY_KEYS,
        F.col("day").cast("long").alias("day"),
        (F.round("historical_average_clicks", 4) + 0.0).alias("shown"),
    )


# ---------------------------------------------------------------- C: joins


@query(
    "c01_activity_type_join",
    "WITH " + _RES
    + """SELECT e.unit, e.period, e.entity, CAST(e.day AS BIGINT) AS day, e.resource, e.clicks,
      coalesce(r.activity_type, 'unknown') AS activity_type
      FROM ev e LEFT JOIN resources r ON r.unit = e.unit AND r.period = e.period AND r.resource = e.resource""",
)
def type_join(spark, sf):
    return tidy(D.with_activity_type(A.raw_log(spark, sf), A.resources(spark, sf)))


@query(
    "c01_activity_type_join_salted",
    "WITH " + _RES
    + """SELECT e.unit, e.period, coalesce(r.activity_type, 'unknown') AS activity_type, count(*) AS log_rows
      FROM ev e LEFT JOIN resources r ON r.unit = e.unit AND r.period = e.period AND r.resource = e.resource GROUP BY ALL""",
)
def type_join_salted(spark, sf):
    joined = joins.lookup_join(
        A.raw_log(spark, sf), A.resources(spark, sf), D.RESOURCE_KEYS, spread="entity", limit=-1
    )
    return joined.groupBy("unit", "period", F.coalesce("activity_type", F.lit("unknown")).alias("activity_type")).agg(
        F.count(F.lit(1)).alias("log_rows")
    )


@query(
    "c02_unmatched_resources",
    "WITH " + _RES
    + "SELECT count(*) AS unmatched_site_ids FROM ev e ANTI JOIN resources r ON r.unit = e.unit AND r.period = e.period AND r.resource = e.resource",
)
def unmatched(spark, sf):
    return D.unmatched_resources(A.raw_log(spark, sf), A.resources(spark, sf))


@query(
    "c03_observation_grid",
    "WITH " + A.ROSTER + "SELECT unit, period, entity, CAST(t AS BIGINT) AS observation_day FROM roster, (VALUES (10), (13), (16), (19)) v(t)",
)
def grid(spark, sf):
    return tidy(O.observation_grid(A.roster(spark, sf), A.OBS))


@query("c04_future_inactivity", "WITH " + A.OUTCOMES + tidy_sql(_OUT_KINDS, "outcomes"))
def future(spark, sf):
    return tidy(A.outcomes(spark, sf), list(_OUT_KINDS))


@query("c05_modeling_candidates", "WITH " + A.MODELING + tidy_sql(_MODEL_KINDS, "cand"))
def candidates(spark, sf):
    return tidy(A.candidates(spark, sf), list(_MODEL_KINDS))


@query("c06_rolling_baseline_merge", "WITH " + A.FEATURES + tidy_sql(_BASE_KINDS, "features"))
def merge(spark, sf):
    rolled = A.rolling(spark, sf)
    return tidy(M.merge_features(rolled, personal_baseline(rolled, A.HISTORY)))


@query(
    "c10_prediction_coverage",
    "WITH " + A.PREDICTIONS
    + """SELECT count(*) FILTER (WHERE m.entity IS NULL) AS unexpected_predictions,
      count(*) FILTER (WHERE p.entity IS NULL) AS missing_predictions,
      count(*) FILTER (WHERE p.actual_label <> CAST(m.future_inactivity AS INTEGER)) AS label_mismatches
      FROM (SELECT * FROM pred WHERE observation_day <> 19) p FULL JOIN (SELECT * FROM modeling WHERE observation_day <> 10) m
      ON m.unit = p.unit AND m.period = p.period AND m.entity = p.entity AND m.observation_day = p.observation_day""",
)
def coverage(spark, sf):
    return P.prediction_coverage(
        A.predictions(spark, sf).where("observation_day <> 19"),
        A.modeling(spark, sf).where("observation_day <> 10"),
        OBSERVATION_KEYS,
        "actual_label",
        "future_inactivity",
    )


@query(
    "c16_table_differences",
    "WITH " + A.SHIFTED + """,
l AS (SELECT unit, period, entity, day, total_clicks AS clicks, total_clicks / 3.0 AS third FROM daily),
r AS (SELECT unit, period, entity, day, total_clicks AS clicks, (total_clicks + CASE WHEN entity % 5 = 0 THEN 1 ELSE 0 END) / 3.0 AS third FROM daily WHERE entity % 4 <> 1)
SELECT 'left_only_rows' AS field, (SELECT count(*) FROM l ANTI JOIN r USING (unit, period, entity, day)) AS mismatches
UNION ALL SELECT 'right_only_rows', (SELECT count(*) FROM r ANTI JOIN l USING (unit, period, entity, day))
UNION ALL SELECT 'clicks', (SELECT count(*) FROM l JOIN r USING (unit, period, entity, day) WHERE l.clicks <> r.clicks)
UNION ALL SELECT 'third', (SELECT count(*) FROM l JOIN r USING (unit, period, entity, day) WHERE abs(l.third - r.third) > 1e-9)""",
)
def differences(spark, sf):
    left = A.daily(spark, sf).select(
        *ENTITY_KEYS, "day", F.col("total_clicks").alias("clicks"), (F.col("total_clicks") / 3.0).alias("third")
    )
    bump = F.when(F.col("entity") % 5 == 0, 1).otherwise(0)
    right = left.where("entity % 4 <> 1").withColumn("third", (F.col("clicks") + bump) / 3.0)
    return P.table_differences(left, right, [*ENTITY_KEYS, "day"], ["clicks", "third"])


# ---------------------------------------------------------------- D2-D10


@query(
    "d02_raw_statistics",
    "WITH " + A.EV + "SELECT count(*) AS raw_rows, CAST(sum(clicks) AS BIGINT) AS total_clicks, count(*) FILTER (WHERE clicks < 0) AS negative_rows FROM ev",
)
def raw_statistics(spark, sf):
    return D.raw_statistics(A.events(spark, sf))


@query(
    "d03_daily_statistics",
    "WITH " + A.DAILY
    + "SELECT count(*) AS daily_rows, count(DISTINCT unit) AS units, count(DISTINCT (unit, period)) AS unit_periods, "
    "count(DISTINCT entity) AS entities, CAST(sum(total_clicks) AS BIGINT) AS total_clicks, "
    "count(*) FILTER (WHERE total_clicks < 0) AS negative_rows, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in DAILY_COLUMNS)
    + " FROM daily",
)
def daily_statistics(spark, sf):
    return D.daily_statistics(A.daily(spark, sf))


@query(
    "d04_duplicate_keys",
    "WITH " + A.EV
    + "SELECT count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM ev GROUP BY unit, period, entity, day)",
)
def duplicates(spark, sf):
    return D.duplicate_key_counts(A.events(spark, sf), [*ENTITY_KEYS, "day"])


@query(
    "d05_day_ranges",
    "WITH " + A.DAILY + "SELECT unit, period, CAST(min(day) AS BIGINT) AS minimum_day, CAST(max(day) AS BIGINT) AS maximum_day FROM daily GROUP BY ALL",
)
def day_ranges(spark, sf):
    return tidy(D.day_ranges(A.daily(spark, sf)))


@query(
    "d06_conservation",
    "WITH " + A.DAILY
    + "SELECT b AS clicks_before, a AS clicks_after, CAST(a = b AS BIGINT) AS conserved FROM (SELECT CAST((SELECT sum(clicks) FROM ev) AS BIGINT) AS b, CAST((SELECT sum(total_clicks) FROM daily) AS BIGINT) AS a)",
)
def conservation(spark, sf):
    return tidy(D.conservation(A.events(spark, sf), A.daily(spark, sf)))


_REPORT = """SELECT {k}, count(*) AS table_rows, count(DISTINCT entity) AS entities,
 count(*) FILTER (WHERE future_inactivity) AS positive, count(*) FILTER (WHERE NOT future_inactivity) AS negative,
 round(avg(CAST(future_inactivity AS INTEGER)), 6) + 0.0 AS prevalence,
 CASE WHEN bool_or(future_inactivity) AND NOT bool_and(future_inactivity) THEN 'both_classes' ELSE 'single_class_descriptive_only' END AS training_suitability,
 CASE WHEN NOT (bool_or(future_inactivity) AND NOT bool_and(future_inactivity)) THEN 'single_class'
      WHEN count(*) FILTER (WHERE future_inactivity) < 20 THEN 'few_positive_rows' END AS warning
 FROM modeling GROUP BY {k}"""


@query("d07_report_by_day", "WITH " + A.MODELING + _REPORT.format(k="observation_day"))
def report_by_day(spark, sf):
    return tidy(M.report_by(A.modeling(spark, sf), ["observation_day"]))


@query("d07_report_by_unit_period", "WITH " + A.MODELING + _REPORT.format(k="unit, period"))
def report_by_unit(spark, sf):
    return tidy(M.report_by(A.modeling(spark, sf), ["unit", "period"]))


@query(
    "d08_nulls_per_field",
    "WITH " + A.MODELING
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls FROM cand" for c in MODEL_FEATURES),
)
def nulls(spark, sf):
    return M.null_counts(A.candidates(spark, sf), MODEL_FEATURES)


@query(
    "d09_exclusion_counts",
    "WITH " + A.MODELING
    + "SELECT reason, count(*) AS excluded_rows FROM (SELECT unnest(string_split(exclusion_reasons, '|')) AS reason FROM cand WHERE exclusion_reasons IS NOT NULL) GROUP BY ALL",
)
def exclusion_counts(spark, sf):
    return M.exclusion_counts(A.candidates(spark, sf))


@query(
    "d10_integrity_violations",
    "WITH " + A.MODELING
    + """SELECT count(*) AS table_rows, count(*) - count(DISTINCT (unit, period, entity, observation_day)) AS duplicate_rows,
      count(*) FILTER (WHERE NOT prediction_eligible OR officially_withdrawn_by_observation_day OR future_inactivity IS NULL) AS invalid_rows,
      count(*) FILTER (WHERE clicks_last_7_days < 0) AS negative_rows, count(DISTINCT observation_day) AS days,
      count(DISTINCT future_inactivity) AS classes FROM cand""",
)
def integrity(spark, sf):
    return tidy(M.integrity_violations(A.candidates(spark, sf)))


# ---------------------------------------------------------------- F, G, H


@query("f01_key_sorted_output", "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily ORDER BY unit, period, entity, day"))
def sorted_output(spark, sf):
    return tidy(A.daily(spark, sf).orderBy("unit", "period", "entity", "day"))


@query(
    "f02_m01_replay_window",
    "WITH " + _RES
    + """SELECT e.unit, e.period, e.entity, CAST(e.day AS BIGINT) AS day, e.resource, e.clicks,
      coalesce(r.activity_type, 'unknown') AS activity_type
      FROM ev e LEFT JOIN resources r ON r.unit = e.unit AND r.period = e.period AND r.resource = e.resource
      WHERE e.unit = 'M1' AND e.period = 'P1' AND e.day BETWEEN 2 AND 9 ORDER BY day, entity, resource""",
)
def replay_window(spark, sf):
    from tidemark.plans.jobs import replay

    return tidy(replay(A.raw_log(spark, sf), A.resources(spark, sf), "M1", "P1", 2, 9))


@query(
    "f03_display_limit",
    "WITH " + A.DAILY + "SELECT unit, period, entity, CAST(day AS BIGINT) AS day, CAST(total_clicks AS BIGINT) AS total_clicks FROM daily ORDER BY unit, period, entity, day LIMIT 12",
)
def display_limit(spark, sf):
    shown = A.daily(spark, sf).orderBy("unit", "period", "entity", "day").limit(12)
    return tidy(shown.select("unit", "period", "entity", "day", "total_clicks"))


@query(
    "g01_union_with_provenance",
    "WITH " + A.PREDICTIONS
    + """SELECT unit, period, entity, observation_day, CASE WHEN observation_day IN (13, 19) THEN 'reused' ELSE 'generated' END AS prediction_provenance,
      round(calibrated_output, 6) + 0.0 AS calibrated_output FROM pred""",
)
def provenance(spark, sf):
    p = A.predictions(spark, sf).select(*OBSERVATION_KEYS, "calibrated_output")
    merged = P.union_with_provenance(
        {"reused": p.where("observation_day IN (13, 19)"), "generated": p.where("observation_day IN (10, 16)")},
        OBSERVATION_KEYS,
    )
    return tidy(merged)


@query(
    "g02_shared_entities",
    "WITH " + A.MODELING + "SELECT entity FROM modeling WHERE unit = 'M0' INTERSECT SELECT entity FROM modeling WHERE unit = 'M1'",
)
def shared(spark, sf):
    m = A.modeling(spark, sf)
    return P.shared_entities(m.where("unit = 'M0'"), m.where("unit = 'M1'"))


@query(
    "g03_key_difference",
    "WITH " + A.MODELING + "SELECT unit, period, entity FROM roster EXCEPT SELECT unit, period, entity FROM modeling WHERE observation_day = 19",
)
def difference(spark, sf):
    return P.key_difference(A.roster(spark, sf), A.modeling(spark, sf).where("observation_day = 19"), ENTITY_KEYS)


@query(
    "g04_concatenate_partitions",
    "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily"),
)
def concatenate(spark, sf):
    root = _written_daily(spark, sf)
    parts = [T.read_daily(spark, root, unit=u) for u in ("M0", "M1", "M2")]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("g05_distinct_days", "WITH " + A.MODELING + "SELECT DISTINCT observation_day FROM modeling")
def distinct_days(spark, sf):
    return tidy(A.modeling(spark, sf).select("observation_day").distinct())


_INFO_LABELS = (
    "WITH " + A.ROSTER + A.INFO + """,
b AS (SELECT list_sort(list_distinct(quantile_cont(CAST(credits AS DOUBLE), [0.25, 0.5, 0.75]))) AS q FROM info),
labelled AS (SELECT unit, period, entity,
  CASE WHEN trim(segment) IN ('', '?') THEN 'Unknown / Not recorded' ELSE trim(segment) END AS segment,
  CASE WHEN trim(region) IN ('', '?') THEN 'Unknown / Not recorded' ELSE trim(region) END AS region, age_band,
  CASE WHEN attempts IN ('0', '1') THEN attempts ELSE '2 or more' END AS attempts,
  CASE WHEN CAST(credits AS DOUBLE) <= q[1] THEN 'credits <= ' || printf('%g', q[1])
       WHEN CAST(credits AS DOUBLE) <= q[2] THEN printf('%g', q[1]) || ' < credits <= ' || printf('%g', q[2])
       WHEN CAST(credits AS DOUBLE) <= q[3] THEN printf('%g', q[2]) || ' < credits <= ' || printf('%g', q[3])
       ELSE 'credits > ' || printf('%g', q[3]) END AS credits
  FROM info, b)
"""
)


@query("h01_h03_attribute_bands", _INFO_LABELS + "SELECT * FROM labelled")
def attribute_bands(spark, sf):
    from tidemark.operators.audit import labelled_attributes

    return labelled_attributes(
        A.info(spark, sf), ["segment", "region", "age_band"], attempts="attempts", credits="credits"
    )


@query(
    "h04_h05_logit_clamp",
    "WITH " + A.PREDICTIONS
    + """SELECT unit, period, entity, observation_day, round(ln(p / (1 - p)), 6) + 0.0 AS logit, round(least(greatest(z, 0.0), 1.0), 6) + 0.0 AS clamped
      FROM (SELECT *, least(greatest(calibrated_output, 1e-15), 1 - 1e-15) AS p, coalesce(click_z_score, 0) AS z FROM pred)""",
)
def logit_clamp(spark, sf):
    return A.predictions(spark, sf).select(
        *OBSERVATION_KEYS,
        r6(scalars.logit(F.col("calibrated_output"))).alias("logit"),
        r6(scalars.clamp01(F.coalesce("click_z_score", F.lit(0.0)))).alias("clamped"),
    )


@query(
    "h08_hash_integers",
    "WITH " + A.ROSTER
    + "SELECT unit, period, entity, CAST(('0x' || substr(md5(unit || '|' || period || '|' || entity), 1, 15)) AS BIGINT) AS h, sha256(unit || '|' || period) AS fingerprint FROM roster",
)
def hashes(spark, sf):
    return A.roster(spark, sf).select(
        *ENTITY_KEYS,
        scalars.hash_int(F.col("unit"), F.col("period"), F.col("entity")).alias("h"),
        F.sha2(F.concat_ws("|", "unit", "period"), 256).alias("fingerprint"),
    )


@query(
    "h11_list_size_check",
    "WITH " + A.DAILY
    + "SELECT count(*) FILTER (WHERE len(resource_ids) <> number_of_resources_visited) AS resource_count_mismatches, count(*) FILTER (WHERE len(activity_types) <> number_of_activity_types_used) AS type_count_mismatches FROM daily",
)
def size_check(spark, sf):
    return D.size_mismatches(A.daily(spark, sf))


# ---------------------------------------------------------------- M: jobs


@query("m04_entity_features", "WITH " + A.FEATURES + tidy_sql(_BASE_KINDS, "features WHERE unit = 'M1' AND period = 'P0' AND day >= 0"))
def entity_features(spark, sf):
    from tidemark.plans.jobs import course_features

    root = _written_daily(spark, sf)
    return tidy(course_features(T.read_daily(spark, root), unit="M1", period="P0", start_day=0, end_day=A.LAST_DAY, minimum_history=A.HISTORY))


@query(
    "m05_entity_outcomes",
    "WITH " + A.OUTCOMES.replace("(VALUES (10), (13), (16), (19)) v(t)", "range(5, 25) v(t)")
    + """SELECT unit, period, entity, observation_day, CAST(future_activity_days AS BIGINT) AS future_activity_days,
      CAST(future_clicks AS BIGINT) AS future_clicks, CAST(future_inactivity AS BIGINT) AS future_inactivity,
      CASE WHEN observation_day + 7 > 29 THEN 'future_window_exceeds_course_end' END AS ineligibility_reason
      FROM outc WHERE unit = 'M2' AND period = 'P1' AND entity = 22""",
)
def entity_outcomes(spark, sf):
    from tidemark.plans.jobs import entity_outcomes as job

    out = job(
        A.events(spark, sf), A.lengths(spark, sf), A.withdrawals(spark, sf),
        unit="M2", period="P1", entity=22, start_day=5, end_day=24, horizon=A.HORIZON,
    )
    return tidy(out.select(*OBSERVATION_KEYS, "future_activity_days", "future_clicks", "future_inactivity", "ineligibility_reason"))


@query(
    "m06_modeling_table_one_course",
    "WITH " + A.MODELING + tidy_sql(_MODEL_KINDS, "cand WHERE unit = 'M0' AND period = 'P0'"),
)
def modeling_course(spark, sf):
    from tidemark.plans.jobs import modeling_table

    out = modeling_table(
        A.daily(spark, sf), A.roster(spark, sf), A.lengths(spark, sf), A.withdrawals(spark, sf), A.results(spark, sf),
        days=A.OBS, horizon=A.HORIZON, minimum_history=A.HISTORY, unit="M0", period="P0",
    )
    return tidy(out, list(_MODEL_KINDS))


@query("m07_modeling_table_all_courses", "WITH " + A.MODELING + tidy_sql(_MODEL_KINDS, "modeling"))
def modeling_all(spark, sf):
    from tidemark.plans.jobs import modeling_table

    out = modeling_table(
        A.daily(spark, sf), A.roster(spark, sf), A.lengths(spark, sf), A.withdrawals(spark, sf), A.results(spark, sf),
        days=A.OBS, horizon=A.HORIZON, minimum_history=A.HISTORY,
    )
    return tidy(M.included(out), list(_MODEL_KINDS))
