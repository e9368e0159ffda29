"""The given tables as an activity log, in Spark and in SQL.

The two forms are written separately: the SQL is the oracle's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import holdout_id, inverse_logit
from tidemark.operators.baseline import personal_baseline
from tidemark.operators.daily import daily_activity
from tidemark.operators.modeling import assemble, included
from tidemark.operators.outcomes import future_inactivity
from tidemark.operators.rolling import rolling_features
from tidemark.schema import MODEL_FEATURES, TARGET
from tidemark.session import scratch_folder
from tidemark.sources.activity import as_activity_log

OBS = (10, 13, 16, 19)
STEP = 3
HORIZON = 7
LENGTH = 30
HISTORY = 3
LAST_DAY = LENGTH - 1

TYPES = {
    "click": "homepage",
    "view": "oucontent",
    "signup": "forumng",
    "purchase": "quiz",
    "error": "externalquiz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return as_activity_log(
        raw,
        unit=F.concat(F.lit("M"), (F.col("k") % 3).cast("string")),
        period=F.concat(F.lit("P"), (F.floor(F.col("k") / 3) % 2).cast("string")),
        entity=F.col("user_id"),
        day=F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + shift,
        resource=F.col("k"),
        clicks=F.ceil("value"),
        activity_type=kind[F.col("event_type")],
    )


def raw_log(spark, sf_dir):
    return events(spark, sf_dir).drop("activity_type")


def resources(spark, sf_dir):
    """A lookup derived from the log: every resource not divisible by 7."""
    log = events(spark, sf_dir)
    return (
        log.where(F.col("resource") % 7 != 0)
        .groupBy("unit", "period", "resource")
        .agg(F.min("activity_type").alias("activity_type"))
    )


def roster(spark, sf_dir):
    """All users in all six unit-periods, including those without activity."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity")).distinct()
    courses = F.array(
        *[F.struct(F.lit(f"M{m}").alias("unit"), F.lit(f"P{p}").alias("period")) for m in range(3) for p in range(2)]
    )
    return users.withColumn("c", F.explode(courses)).select("c.unit", "c.period", "entity")


def lengths(spark, sf_dir):
    return events(spark, sf_dir).select("unit", "period").distinct().withColumn("length_days", F.lit(LENGTH))


def withdrawals(spark, sf_dir):
    return roster(spark, sf_dir).where(F.col("entity") % 11 == 0).withColumn(
        "withdrawal_day", (F.lit(12) + F.col("entity") % 7).cast("long")
    )


def results(spark, sf_dir):
    return roster(spark, sf_dir).withColumn(
        "final_result",
        F.when(F.col("entity") % 3 == 0, "Pass").when(F.col("entity") % 3 == 1, "Fail").otherwise("Withdrawn"),
    )


def daily(spark, sf_dir, shift: int = 0):
    return daily_activity(events(spark, sf_dir, shift))


def rolling(spark, sf_dir, shift: int = 0, end: int | None = LAST_DAY):
    return rolling_features(daily(spark, sf_dir, shift), 0, end)


def features(spark, sf_dir, shift: int = 0):
    return personal_baseline(rolling(spark, sf_dir, shift), HISTORY)


def outcomes(spark, sf_dir, days=OBS):
    return future_inactivity(
        daily(spark, sf_dir),
        roster(spark, sf_dir),
        days,
        lengths(spark, sf_dir),
        withdrawals(spark, sf_dir),
        HORIZON,
    )


def candidates(spark, sf_dir):
    return assemble(
        outcomes(spark, sf_dir), features(spark, sf_dir), results(spark, sf_dir), OBS
    )


def modeling(spark, sf_dir):
    return included(candidates(spark, sf_dir))


CUTS = {"fixed": 0.5, "f1_focused": 0.4, "recall_focused": 0.3, "alert_capacity": 0.6}
POLICIES = tuple(CUTS)


def predictions(spark, sf_dir):
    """Rows scored by a fixed formula, with saved threshold decisions."""
    # a multiple of 2^-20, so sums of scores are exact in every engine
    score = F.floor(
        inverse_logit(
            F.lit(-1.2)
            + F.lit(0.25) * F.coalesce(F.col("current_inactivity_gap"), F.lit(12))
            - F.lit(0.3) * F.col("active_days_last_7_days")
            - F.lit(0.002) * F.col("clicks_last_7_days")
        )
        * 1048576.0
    ) / F.lit(1048576.0)
    rows = modeling(spark, sf_dir).select(
        "unit",
        "period",
        "entity",
        "observation_day",
        F.col(TARGET).cast("int").alias("actual_label"),
        score.alias("calibrated_output"),
        "future_window_start_day",
        "future_window_end_day",
        *MODEL_FEATURES,
    )
    rows = rows.withColumn("outer_holdout_id", holdout_id("unit", "period"))
    for name, cut in CUTS.items():
        rows = rows.withColumn(f"{name}_threshold", F.lit(cut)).withColumn(
            f"{name}_prediction", (F.col("calibrated_output") >= cut).cast("int")
        )
    return rows


def by_segment(spark, sf_dir, rows):
    """Holdouts of market segment and period: people share periods, not segments."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return rows.join(people, "entity").withColumn(
        "outer_holdout_id", F.concat_ws("_", "c_mktsegment", "period")
    ).drop("c_mktsegment")


_SAVED: dict[tuple[str, str, str], str] = {}


def _saved(spark, sf_dir, name, build):
    """A table written once per application and read by later stages."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SAVED:
        path = scratch_folder(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key])


def saved_predictions(spark, sf_dir):
    """Audits start from saved predictions, as they would in production."""
    return _saved(spark, sf_dir, "predictions", predictions)


def saved_daily(spark, sf_dir):
    return _saved(spark, sf_dir, "daily", daily)


ATTRIBUTES = ["segment", "region", "age_band", "attempts", "credits"]
PAIRS = [("segment", "age_band"), ("segment", "region"), ("age_band", "region"), ("attempts", "age_band")]


def info(spark, sf_dir):
    """Raw demographic text per enrolment, with ``?`` and blanks for missing."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    people = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("entity"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("?")).otherwise(F.col("c_mktsegment")).alias("segment"),
            F.when(F.col("r_name") == "AFRICA", F.lit(" ")).otherwise(F.col("r_name")).alias("region"),
            F.when(F.col("c_custkey") % 3 == 0, "0-35").when(F.col("c_custkey") % 3 == 1, "35-55").otherwise("55<=").alias("age_band"),
            (F.col("c_nationkey") % 4).cast("string").alias("attempts"),
            F.round(F.abs("c_acctbal") / 10).cast("int").cast("string").alias("credits"),
        )
    )
    return roster(spark, sf_dir).where(F.col("entity") % 17 != 5).join(people, "entity")


# ---------------------------------------------------------------- oracle SQL

EV = """
ev AS (
  SELECT 'M' || (k % 3) AS unit, 'P' || ((k // 3) % 2) AS period, user_id AS entity,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         CAST(k AS BIGINT) AS resource, CAST(ceil(value) AS BIGINT) AS clicks,
         CASE event_type WHEN 'click' THEN 'homepage' WHEN 'view' THEN 'oucontent'
              WHEN 'signup' THEN 'forumng' WHEN 'purchase' THEN 'quiz'
              WHEN 'error' THEN 'externalquiz' END AS activity_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""

DAILY = EV + """,
daily AS (
  SELECT unit, period, entity, day, sum(clicks) AS total_clicks,
         count(DISTINCT resource) AS number_of_resources_visited,
         count(DISTINCT activity_type) AS number_of_activity_types_used,
         sum(CASE WHEN activity_type = 'homepage' THEN clicks ELSE 0 END) AS homepage_clicks,
         sum(CASE WHEN activity_type = 'forumng' THEN clicks ELSE 0 END) AS forum_clicks,
         sum(CASE WHEN activity_type = 'oucontent' THEN clicks ELSE 0 END) AS content_clicks,
         sum(CASE WHEN activity_type IN ('quiz', 'externalquiz') THEN clicks ELSE 0 END) AS quiz_clicks,
         list_sort(list(DISTINCT resource)) AS resource_ids,
         list_sort(list(DISTINCT activity_type)) AS activity_types
  FROM ev GROUP BY ALL)
"""

_ROLL_BODY = """,
span AS (SELECT unit, period, entity, min(day) AS first_day, max(day) AS final_day FROM {d} GROUP BY ALL),
cal AS (SELECT unit, period, entity, unnest(generate_series({start}, {end})) AS day, {start} AS output_start FROM span),
rolling AS (
  SELECT c.unit, c.period, c.entity, CAST(c.day AS INTEGER) AS day,
         c.day >= c.output_start + 6 AS window_complete,
         coalesce(sum(d.total_clicks), 0) AS clicks_last_7_days,
         count(d.day) AS active_days_last_7_days,
         (SELECT count(DISTINCT e.resource) FROM {e} e WHERE e.unit = c.unit AND e.period = c.period
             AND e.entity = c.entity AND e.day BETWEEN c.day - 6 AND c.day) AS resources_last_7_days,
         (SELECT count(DISTINCT e.activity_type) FROM {e} e WHERE e.unit = c.unit AND e.period = c.period
             AND e.entity = c.entity AND e.day BETWEEN c.day - 6 AND c.day) AS activity_types_last_7_days,
         coalesce(sum(d.homepage_clicks), 0) AS homepage_clicks_last_7_days,
         coalesce(sum(d.forum_clicks), 0) AS forum_clicks_last_7_days,
         coalesce(sum(d.content_clicks), 0) AS content_clicks_last_7_days,
         coalesce(sum(d.quiz_clicks), 0) AS quiz_clicks_last_7_days,
         c.day - (SELECT max(x.day) FROM {d} x WHERE x.unit = c.unit AND x.period = c.period
             AND x.entity = c.entity AND x.day <= c.day) AS days_since_last_activity
  FROM cal c LEFT JOIN {d} d ON d.unit = c.unit AND d.period = c.period AND d.entity = c.entity
       AND d.day BETWEEN c.day - 6 AND c.day
  GROUP BY c.unit, c.period, c.entity, c.day, c.output_start)
"""

SHIFTED = DAILY + """,
evs AS (SELECT * REPLACE (CAST(day - 4 AS INTEGER) AS day) FROM ev),
ds AS (SELECT * REPLACE (CAST(day - 4 AS INTEGER) AS day) FROM daily)
"""

_BASE_BODY = """,
hist AS (
  SELECT *,
    count(CASE WHEN window_complete THEN 1 END) OVER w AS historical_windows_available,
    avg(CASE WHEN window_complete THEN clicks_last_7_days END) OVER w AS historical_average_clicks,
    stddev_samp(CASE WHEN window_complete THEN clicks_last_7_days END) OVER w AS historical_standard_deviation_clicks,
    avg(CASE WHEN window_complete THEN active_days_last_7_days END) OVER w AS historical_average_active_days,
    max(days_since_last_activity) OVER w AS longest_previous_inactivity_gap
  FROM rolling
  WINDOW w AS (PARTITION BY unit, period, entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
features AS (
  SELECT *, historical_windows_available >= 3 AS baseline_ready,
    clicks_last_7_days - historical_average_clicks AS click_difference_from_personal_average,
    CASE WHEN historical_average_clicks <> 0 THEN
      (clicks_last_7_days - historical_average_clicks) / historical_average_clicks * 100 END AS click_percentage_change_from_personal_average,
    CASE WHEN historical_standard_deviation_clicks <> 0 THEN
      (clicks_last_7_days - historical_average_clicks) / historical_standard_deviation_clicks END AS click_z_score,
    active_days_last_7_days - historical_average_active_days AS active_days_difference_from_personal_average,
    days_since_last_activity AS current_inactivity_gap
  FROM hist)
"""


def rolling_sql(d: str = "daily", e: str = "ev", start: str = "0", end: str = "29", base: str = DAILY) -> str:
    return base + _ROLL_BODY.format(d=d, e=e, start=start, end=end)


ROLLING = rolling_sql()
FEATURES = ROLLING + _BASE_BODY
FEATURES_SHIFTED = rolling_sql("ds", "evs", base=SHIFTED) + _BASE_BODY

_ROSTER = """,
users AS (SELECT DISTINCT user_id AS entity FROM events),
roster AS (SELECT 'M' || m AS unit, 'P' || p AS period, entity FROM users, range(3) a(m), range(2) b(p)),
wd AS (SELECT *, 12 + entity % 7 AS withdrawal_day FROM roster WHERE entity % 11 = 0),
res AS (SELECT *, CASE WHEN entity % 3 = 0 THEN 'Pass' WHEN entity % 3 = 1 THEN 'Fail' ELSE 'Withdrawn' END AS final_result FROM roster)
"""
ROSTER = EV + _ROSTER

_OUT_BODY = _ROSTER + """,
grid AS (SELECT r.*, t AS observation_day FROM roster r, (VALUES (10), (13), (16), (19)) v(t)),
outc AS (
  SELECT g.unit, g.period, g.entity, g.observation_day,
    g.observation_day + 1 AS future_window_start_day, g.observation_day + 7 AS future_window_end_day,
    CASE WHEN g.observation_day + 7 <= 29 THEN count(d.day) END AS future_activity_days,
    CASE WHEN g.observation_day + 7 <= 29 THEN coalesce(sum(d.total_clicks), 0) END AS future_clicks,
    CASE WHEN g.observation_day + 7 <= 29 THEN count(d.day) = 0 END AS future_inactivity,
    any_value(w.withdrawal_day) AS official_withdrawal_day,
    coalesce(any_value(w.withdrawal_day) <= g.observation_day, false) AS officially_withdrawn_by_observation_day,
    coalesce(any_value(w.withdrawal_day) <= g.observation_day + 7, false) AS officially_withdrawn_by_window_end
  FROM grid g LEFT JOIN wd w ON w.unit = g.unit AND w.period = g.period AND w.entity = g.entity
  LEFT JOIN daily d ON d.unit = g.unit AND d.period = g.period AND d.entity = g.entity
       AND d.day BETWEEN g.observation_day + 1 AND g.observation_day + 7
  GROUP BY g.unit, g.period, g.entity, g.observation_day),
outcomes AS (
  SELECT *, true AS outcome_eligible, CAST(NULL AS VARCHAR) AS ineligibility_reason,
    NOT officially_withdrawn_by_observation_day AS prediction_eligible,
    CASE WHEN officially_withdrawn_by_observation_day THEN 'already_withdrawn_by_observation_day' END AS prediction_ineligibility_reason
  FROM outc)
"""
OUTCOMES = DAILY + _OUT_BODY

_FEATURE_LIST = ", ".join(f"f.{c}" for c in MODEL_FEATURES)
_MODEL_BODY = _OUT_BODY + f""",
cand AS (
  SELECT o.*, {_FEATURE_LIST}, f.window_complete, f.baseline_ready, r.final_result,
    nullif(concat_ws('|',
      CASE WHEN f.day IS NULL THEN 'missing_rolling_features' WHEN NOT f.window_complete THEN 'partial_rolling_window' END,
      CASE WHEN f.day IS NULL THEN 'missing_personal_baseline' WHEN NOT f.baseline_ready THEN 'baseline_not_ready' END,
      CASE WHEN NOT o.prediction_eligible THEN o.prediction_ineligibility_reason END,
      CASE WHEN o.officially_withdrawn_by_observation_day THEN 'withdrawn_by_observation_day' END), '') AS exclusion_reasons
  FROM outcomes o
  LEFT JOIN features f ON f.unit = o.unit AND f.period = o.period AND f.entity = o.entity AND f.day = o.observation_day
  LEFT JOIN res r ON r.unit = o.unit AND r.period = o.period AND r.entity = o.entity),
modeling AS (SELECT * FROM cand WHERE exclusion_reasons IS NULL)
"""
MODELING = FEATURES + _MODEL_BODY

PREDICTIONS = MODELING + """,
scored AS (
  SELECT *, CAST(future_inactivity AS INTEGER) AS actual_label, unit || '_' || period AS outer_holdout_id,
    floor(CAST(1.0 AS DOUBLE) / (1.0 + exp(-(CAST(-1.2 AS DOUBLE) + CAST(0.25 AS DOUBLE) * coalesce(current_inactivity_gap, 12)
      - CAST(0.3 AS DOUBLE) * active_days_last_7_days - CAST(0.002 AS DOUBLE) * clicks_last_7_days))) * CAST(1048576 AS DOUBLE)) / CAST(1048576 AS DOUBLE) AS calibrated_output
  FROM modeling),
pred AS (
  SELECT *, CAST(0.5 AS DOUBLE) AS fixed_threshold, CAST(0.4 AS DOUBLE) AS f1_focused_threshold,
    CAST(0.3 AS DOUBLE) AS recall_focused_threshold, CAST(0.6 AS DOUBLE) AS alert_capacity_threshold,
    CAST(calibrated_output >= CAST(0.5 AS DOUBLE) AS INTEGER) AS fixed_prediction,
    CAST(calibrated_output >= CAST(0.4 AS DOUBLE) AS INTEGER) AS f1_focused_prediction,
    CAST(calibrated_output >= CAST(0.3 AS DOUBLE) AS INTEGER) AS recall_focused_prediction,
    CAST(calibrated_output >= CAST(0.6 AS DOUBLE) AS INTEGER) AS alert_capacity_prediction
  FROM scored)
"""

INFO = """,
info AS (
  SELECT ro.unit, ro.period, ro.entity,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '?' ELSE c_mktsegment END AS segment,
    CASE WHEN r_name = 'AFRICA' THEN ' ' ELSE r_name END AS region,
    CASE c_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,
    CAST(c_nationkey % 4 AS VARCHAR) AS attempts,
    CAST(CAST(round(abs(c_acctbal) / 10) AS INTEGER) AS VARCHAR) AS credits
  FROM roster ro JOIN customer ON c_custkey = ro.entity JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE ro.entity % 17 <> 5)
"""

SEGMENTED = """
p0 AS (SELECT p.* REPLACE (c_mktsegment || '_' || period AS outer_holdout_id) FROM pred p JOIN customer ON c_custkey = entity)
"""
