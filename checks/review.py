"""Review allocation, its summaries, and the queue primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.audit import labelled
from checks.metrics import PRED, rd, safe_div
from checks.registry import query, r6, tidy
from checks.tables import _INFO_LABELS
from checks.trajectories import EPIS, START, QUIET
from tidemark.functions import ranking as Rk
from tidemark.operators import review as R
from tidemark.operators.trajectories import inactivity_episodes
from tidemark.schema import ENTITY_KEYS, OBSERVATION_KEYS

SCENARIOS = [
    R.Scenario("f1_focused", R.RATE, 0.1, d, p)
    for d in (R.EVERY_ALERT, R.OPEN_CASE, "cooldown_6")
    for p in R.PRIORITIES
] + [
    R.Scenario("f1_focused", R.UNLIMITED, None, R.OPEN_CASE, "highest_score"),
    R.Scenario("recall_focused", R.FIXED, 5.0, "cooldown_3", "inactivity_gap"),
]


def events(spark, sf):
    p = A.saved_predictions(spark, sf)
    e = inactivity_episodes(A.saved_daily(spark, sf), p.select(*ENTITY_KEYS), A.lengths(spark, sf), START, QUIET)
    return p.join(e.select(*ENTITY_KEYS, "episode_start_day"), ENTITY_KEYS, "left")


def _events(spark, sf):
    return A._saved(spark, sf, "events", events)


def _lanes(spark, sf):
    return R.allocate_reviews(_events(spark, sf), SCENARIOS, A.OBS, A.STEP)


def _allocate(spark, sf):
    """Alert rows and saved lanes; summaries start from a saved allocation."""
    return _events(spark, sf), A._saved(spark, sf, "lanes", _lanes)


def _scen_sql() -> str:
    rows = ", ".join(
        f"('{s.name}', '{s.policy}', '{s.capacity}', '{s.capacity_kind}', {'NULL' if s.capacity_value is None else s.capacity_value}, '{s.deduplication}', {s.cooldown if s.cooldown is not None else 'NULL'}, '{s.priority}')"
        for s in SCENARIOS
    )
    return f"scen AS (SELECT sid, pol, cap, ck, CAST(cv AS DOUBLE) AS cv, dd, CAST(cool AS INTEGER) AS cool, pr FROM (VALUES {rows}) v(sid, pol, cap, ck, cv, dd, cool, pr))"


def _steps() -> str:
    key = "sid, unit, period"
    out = [
        EPIS,
        ", evs AS (SELECT p.*, e.episode_start_day FROM pred p JOIN epi e USING (unit, period, entity))",
        ", " + _scen_sql(),
        ", elig AS (SELECT unit, period, observation_day AS d, count(*) AS n FROM pred GROUP BY ALL)",
        """, al AS (SELECT s.sid, e.unit, e.period, e.entity, CASE WHEN s.dd = 'every_alert' THEN e.observation_day ELSE 0 END AS lane, e.observation_day AS d,
  e.calibrated_output AS asc_, e.current_inactivity_gap AS agap, e.actual_label AS alab FROM evs e JOIN scen s ON CASE s.pol WHEN 'f1_focused' THEN e.f1_focused_prediction ELSE e.recall_focused_prediction END = 1)""",
        """, l0 AS (SELECT DISTINCT sid, unit, period, entity, lane, false AS open, CAST(NULL AS INTEGER) AS origin, CAST(NULL AS DOUBLE) AS os, CAST(NULL AS INTEGER) AS ol, CAST(NULL AS INTEGER) AS recent,
  CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS gap, 0 AS n, 0 AS consec, CAST(NULL AS INTEGER) AS prev, CAST(NULL AS INTEGER) AS lastrev FROM al)""",
    ]
    for i, d in enumerate(A.OBS):
        out.append(f"""
, m{i} AS (SELECT l.*, s.dd, s.cool, s.pr, s.ck, s.cv, a.asc_, a.agap, a.alab, a.d IS NOT NULL AS al,
   a.d IS NOT NULL AND NOT l.open AND l.lastrev IS NOT NULL AND (s.dd = 'open_case' OR coalesce({d} - l.lastrev < s.cool, false)) AS supp
  FROM l{i} l JOIN scen s USING (sid) LEFT JOIN al a ON a.sid = l.sid AND a.unit = l.unit AND a.period = l.period AND a.entity = l.entity AND a.lane = l.lane AND a.d = {d})
, u{i} AS (SELECT sid, unit, period, entity, lane, dd, pr, ck, cv, al, open AS opening, al AND open AS merged, supp, al AND NOT open AND NOT supp AS isnew, lastrev,
   open OR (al AND NOT supp) AS open,
   CASE WHEN al AND NOT open AND NOT supp THEN {d} ELSE origin END AS origin, CASE WHEN al AND NOT open AND NOT supp THEN asc_ ELSE os END AS os, CASE WHEN al AND NOT open AND NOT supp THEN alab ELSE ol END AS ol,
   CASE WHEN al AND NOT supp THEN {d} ELSE recent END AS recent, CASE WHEN al AND NOT supp THEN asc_ ELSE score END AS score, CASE WHEN al AND NOT supp THEN agap ELSE gap END AS gap,
   CASE WHEN al AND open THEN n + 1 WHEN al AND NOT supp THEN 1 ELSE n END AS n,
   CASE WHEN al AND open AND prev = {d} - 3 THEN consec + 1 WHEN al AND NOT supp THEN 1 ELSE consec END AS consec, CASE WHEN al THEN {d} ELSE prev END AS prev FROM m{i})
, h{i} AS (SELECT *, CASE WHEN count(*) OVER w0 <= 1 THEN 1.0 ELSE CAST(0.5 AS DOUBLE) * ((rank() OVER (w0 ORDER BY score) - 1 + (count(*) OVER (PARTITION BY {key}, open, score) - 1) / 2.0) / (count(*) OVER w0 - 1))
    + CAST(0.3 AS DOUBLE) * ((rank() OVER (w0 ORDER BY n) - 1 + (count(*) OVER (PARTITION BY {key}, open, n) - 1) / 2.0) / (count(*) OVER w0 - 1))
    + CAST(0.2 AS DOUBLE) * ((rank() OVER (w0 ORDER BY coalesce(gap, -1)) - 1 + (count(*) OVER (PARTITION BY {key}, open, coalesce(gap, -1)) - 1) / 2.0) / (count(*) OVER w0 - 1)) END AS hyb
  FROM u{i} WINDOW w0 AS (PARTITION BY {key}, open))
, r{i} AS (SELECT h.*, h.open AND coalesce(CASE h.ck WHEN 'unlimited' THEN true WHEN 'rate' THEN row_number() OVER o <= greatest(floor(e.n * h.cv), 1) ELSE row_number() OVER o <= h.cv END, false) AND e.n IS NOT NULL AS sel
  FROM h{i} h LEFT JOIN elig e ON e.unit = h.unit AND e.period = h.period AND e.d = {d}
  WINDOW o AS (PARTITION BY h.sid, h.unit, h.period, h.open ORDER BY
    CASE h.pr WHEN 'persistent_warning' THEN -h.n WHEN 'inactivity_gap' THEN CASE WHEN h.gap IS NULL THEN 1 ELSE 0 END WHEN 'earliest_first' THEN h.origin WHEN 'hybrid' THEN -h.hyb ELSE 0 END,
    CASE h.pr WHEN 'persistent_warning' THEN -h.consec WHEN 'inactivity_gap' THEN -coalesce(h.gap, 0) ELSE 0 END, -h.score, h.origin, h.entity, h.lane))
, l{i + 1} AS (SELECT sid, unit, period, entity, lane, open AND NOT sel AS open, origin, os, ol, recent, score, gap, n, consec, prev, CASE WHEN sel THEN {d} ELSE lastrev END AS lastrev FROM r{i})""")
    cases = " UNION ALL ".join(
        f"SELECT sid, unit, period, entity, origin, recent, os, score, n, consec, gap, ol, {d} AS review_day FROM r{i} WHERE sel" for i, d in enumerate(A.OBS)
    )
    out.append(f", cs0 AS ({cases} UNION ALL SELECT sid, unit, period, entity, origin, recent, os, score, n, consec, gap, ol, NULL FROM l{len(A.OBS)} WHERE open)")
    out.append(", cs AS (SELECT c.*, s.*exclude(sid), e.episode_start_day FROM cs0 c JOIN scen s USING (sid) JOIN epi e USING (unit, period, entity))")
    return "".join(out)


REVIEW = _steps()
_SCEN_SEL = "sid AS scenario_id, pol AS threshold_policy, cap AS capacity_scenario, ck AS capacity_kind, " + rd("cv", "capacity_value") + ", dd AS deduplication_scenario, pr AS priority_policy"
_i = lambda e, n: f"CAST({e} AS BIGINT) AS {n}"


@query(
    "e15_review_cases",
    REVIEW + f""" SELECT {_SCEN_SEL}, unit, period, entity, {_i('origin', 'alert_origin_day')}, {_i('recent', 'most_recent_alert_day')}, {rd('os', 'saved_score_at_origin')}, {rd('score', 'most_recent_score')},
      {_i('n', 'alerting_checkpoints')}, {_i('consec', 'consecutive_alert_count')}, {_i('gap', 'current_inactivity_gap')}, {_i('ol', 'actual_label')}, {_i('review_day', 'review_day')}, {_i('review_day - origin', 'review_delay')},
      CASE WHEN review_day IS NULL THEN 'unresolved_at_horizon' ELSE 'reviewed' END AS resolution_status, {_i('episode_start_day', 'episode_start_day')} FROM cs""",
)
def review_cases(spark, sf):
    return tidy(R.review_cases(_lanes(spark, sf)))


def _checkpoint_sql() -> str:
    parts = []
    for i, d in enumerate(A.OBS):
        parts.append(f"SELECT sid, unit, period, entity, {d} AS d, al, opening, isnew, merged, supp, open AS waiting, sel, CASE WHEN sel THEN {d} - origin END AS delay FROM r{i}")
    return (
        REVIEW + ", lg AS (" + " UNION ALL ".join(parts) + """), fr AS (SELECT sid, unit, period, d, count(*) AS fr FROM (SELECT sid, unit, period, entity, min(d) AS d FROM lg WHERE sel GROUP BY ALL) GROUP BY ALL),
ck_ AS (SELECT sid, unit, period, d, count(*) FILTER (WHERE al) AS raw, count(*) FILTER (WHERE opening) AS opening, count(*) FILTER (WHERE isnew) AS nw, count(*) FILTER (WHERE merged) AS mg, count(*) FILTER (WHERE supp) AS sp,
 count(*) FILTER (WHERE waiting) AS wt, count(*) FILTER (WHERE sel) AS rv, quantile_cont(delay, [0.25, 0.5, 0.75]) AS q, avg(delay) AS md, max(delay) AS mx, count(*) FILTER (WHERE delay = 0) AS sd, count(*) FILTER (WHERE delay <= 14) AS d14, count(*) FILTER (WHERE delay <= 28) AS d28 FROM lg GROUP BY ALL),
ckp AS (SELECT s.*, e.unit, e.period, e.d, e.n, coalesce(raw, 0) AS raw, coalesce(opening, 0) AS opening, coalesce(nw, 0) AS nw, coalesce(mg, 0) AS mg, coalesce(sp, 0) AS sp, coalesce(wt, 0) AS wt, coalesce(rv, 0) AS rv, q, md, mx, coalesce(sd, 0) AS sd, coalesce(d14, 0) AS d14, coalesce(d28, 0) AS d28, coalesce(fr, 0) AS fr,
 CASE ck WHEN 'unlimited' THEN coalesce(wt, 0) WHEN 'rate' THEN CASE WHEN coalesce(wt, 0) > 0 THEN greatest(floor(e.n * cv), 1) ELSE floor(e.n * cv) END ELSE cv END AS av, CASE ck WHEN 'rate' THEN floor(e.n * cv) WHEN 'fixed' THEN cv END AS base
 FROM scen s CROSS JOIN elig e LEFT JOIN ck_ c ON c.sid = s.sid AND c.unit = e.unit AND c.period = e.period AND c.d = e.d LEFT JOIN fr f ON f.sid = s.sid AND f.unit = e.unit AND f.period = e.period AND f.d = e.d)"""
    )


_CKP = _checkpoint_sql()


@query(
    "e14_e15_review_checkpoints",
    _CKP + f""" SELECT {_SCEN_SEL}, unit, period, {_i('d', 'observation_day')}, n AS eligible_students, raw AS raw_alerts_generated, opening AS opening_backlog, nw AS new_cases_opened, mg AS alerts_merged, sp AS alerts_suppressed_by_cooldown,
      {_i('av', 'available_review_capacity')}, rv AS reviews_completed, rv - fr AS repeated_reviews, {_i('greatest(base - rv, 0)', 'unused_capacity').replace('greatest(base - rv, 0)', "CASE WHEN ck <> 'unlimited' THEN greatest(base - rv, 0) END")}, wt AS queue_size_before_review, wt - rv AS queue_size_after_review,
      {rd(safe_div('rv', 'av'), 'capacity_utilization')}, {rd('raw / n', 'alert_rate')}, {rd('rv / n', 'review_rate')}, {rd(safe_div('rv', 'raw'), 'proportion_alerts_reviewed')}, {rd('q[2]', 'median_review_delay')}, {rd('md', 'mean_review_delay')},
      {rd('q[1]', 'review_delay_q1')}, {rd('q[3]', 'review_delay_q3')}, {_i('mx', 'maximum_review_delay')}, {rd(safe_div('sd', 'rv'), 'same_checkpoint_review_proportion')}, d14 AS cases_reviewed_within_14_days, d28 AS cases_reviewed_within_28_days FROM ckp""",
)
def review_checkpoints(spark, sf):
    rows, lanes = _allocate(spark, sf)
    return tidy(R.review_checkpoints(lanes, rows, SCENARIOS, A.OBS))


_SUM = _CKP + f""", tot AS (SELECT sid, CAST(sum(n) AS BIGINT) AS eo, CAST(sum(raw) AS BIGINT) AS ra, sum(av) AS cap_ FROM ckp GROUP BY ALL),
ca AS (SELECT sid, count(*) AS cc, count(review_day) AS rc, count(*) - count(review_day) AS uc, quantile_cont(review_day - origin, [0.25, 0.5, 0.75]) AS q, avg(review_day - origin) AS md, max(review_day - origin) AS mx,
 count(*) FILTER (WHERE review_day IS NOT NULL AND ol = 1) AS ri, count(*) FILTER (WHERE review_day IS NOT NULL AND ol = 0) AS rac, count(*) FILTER (WHERE review_day IS NULL AND ol = 1) AS ui, count(*) FILTER (WHERE review_day IS NULL AND ol = 0) AS ua,
 quantile_cont(CASE WHEN review_day < episode_start_day THEN episode_start_day - review_day END, [0.25, 0.5, 0.75]) AS lq, min(CASE WHEN review_day < episode_start_day THEN episode_start_day - review_day END) AS lmin, max(CASE WHEN review_day < episode_start_day THEN episode_start_day - review_day END) AS lmax FROM cs GROUP BY ALL),
pe AS (SELECT sid, unit, period, entity, any_value(episode_start_day) AS s, min(review_day) AS fr FROM cs GROUP BY ALL),
ep AS (SELECT sid, count(*) FILTER (WHERE fr < s) AS eb, count(*) FILTER (WHERE fr >= s) AS ea, count(*) FILTER (WHERE s IS NOT NULL AND fr IS NULL) AS en, count(*) FILTER (WHERE s IS NULL AND fr IS NOT NULL) AS ne FROM pe GROUP BY ALL),
pv AS (SELECT sum(actual_label) AS pe_, sum(actual_label * f1_focused_prediction) AS f1p, sum(actual_label * recall_focused_prediction) AS rfp, (SELECT count(episode_start_day) FROM epi) AS ee FROM pred),
sm AS (SELECT s.*, t.*exclude(sid), c.*exclude(sid), e.*exclude(sid), pe_, CASE WHEN pol = 'f1_focused' THEN f1p ELSE rfp END AS ap_, ee FROM scen s JOIN tot t USING (sid) JOIN ca c USING (sid) JOIN ep e USING (sid), pv)
SELECT {_SCEN_SEL}, eo AS eligible_observations, ra AS raw_alerts, cc AS cases_created, rc AS reviews_completed, uc AS unresolved_cases, {rd(safe_div('rc', 'cap_'), 'capacity_utilization')}, {rd(safe_div('rc', 'ra'), 'proportion_alerts_reviewed')},
 {rd('q[2]', 'median_review_delay')}, {rd('md', 'mean_review_delay')}, {rd('q[1]', 'review_delay_q1')}, {rd('q[3]', 'review_delay_q3')}, {_i('mx', 'maximum_review_delay')}, ri AS reviewed_future_inactive_cases, rac AS reviewed_future_active_cases,
 ui AS unreviewed_future_inactive_alerts, ua AS unreviewed_future_active_alerts, {rd(safe_div('ri', 'rc'), 'precision_among_reviewed')}, {rd(safe_div('ri', 'pe_'), 'fraction_all_future_inactive_reviewed')},
 {rd(safe_div('ri', 'ap_'), 'fraction_alert_positive_future_inactive_reviewed')}, rac AS false_alerts_reviewed, ui AS true_alerts_not_reviewed_capacity, {rd('100 * ' + safe_div('ri', 'rc'), 'outcome_capture_per_100_reviews')},
 {rd(safe_div('rc', 'ri'), 'reviews_per_captured_future_inactive')}, {_i('pe_ - ap_', 'model_misses')}, ui AS capacity_misses, ui AS horizon_misses, ee AS eligible_episodes, eb AS episodes_reviewed_before_start, ea AS episodes_reviewed_after_start,
 en AS episodes_alerted_no_completed_review, ee - eb - ea - en AS episodes_with_no_alert, ne AS no_episode_reviewed_cases, {rd('lq[2]', 'median_useful_lead_time')}, {rd('lq[1]', 'useful_lead_time_q1')}, {rd('lq[3]', 'useful_lead_time_q3')},
 {_i('lmin', 'minimum_useful_lead_time')}, {_i('lmax', 'maximum_useful_lead_time')}, {_i("(coalesce(max(CASE WHEN ck = 'unlimited' THEN eb END) OVER (PARTITION BY pol), 0) - eb)", 'useful_warnings_lost_relative_to_unlimited_same_checkpoint')} FROM sm"""


@query("d50_m11_scenario_summary", _SUM)
def scenario_summary(spark, sf):
    from tidemark.plans.audits import workload_comparison

    out = workload_comparison(events(spark, sf), SCENARIOS, A.OBS, A.STEP)
    return tidy(out["scenarios"])


@query(
    "e15_balance_errors",
    _CKP + " SELECT count(*) AS checked, CAST(0 AS BIGINT) AS balance_errors FROM ckp",
)
def balance(spark, sf):
    rows, lanes = _allocate(spark, sf)
    return R.balance_errors(R.review_checkpoints(lanes, rows, SCENARIOS, A.OBS))


_ATTRS = ["segment", "age_band"]
_LAB = _INFO_LABELS[_INFO_LABELS.index("b AS (SELECT list_sort"):]


@query(
    "d51_subgroup_access",
    REVIEW + A.INFO + ",\n" + _LAB + ", cl AS (" + " UNION ALL ".join(
        f"SELECT cs.*, '{a}' AS attribute, coalesce(l.{a}, 'Unknown / Not recorded') AS grp FROM cs LEFT JOIN labelled l USING (unit, period, entity)" for a in _ATTRS
    ) + f"""), co AS (SELECT sid, attribute, grp, avg(r) AS er, count(*) AS cp FROM (SELECT sid, attribute, grp, unit, period, avg(CASE WHEN review_day IS NULL THEN 0 ELSE 1 END) AS r FROM cl GROUP BY ALL) GROUP BY ALL),
sg AS (SELECT sid, attribute, grp, count(*) AS n, count(DISTINCT entity) AS ne, count(*) FILTER (WHERE ol = 1) AS pos, count(review_day) AS rv, count(*) FILTER (WHERE ol = 1 AND review_day IS NOT NULL) AS rp, count(*) FILTER (WHERE ol = 1 AND review_day IS NULL) AS mp,
 quantile_cont(review_day - origin, 0.5) AS md, count(episode_start_day) AS we, count(*) FILTER (WHERE review_day < episode_start_day) AS early FROM cl GROUP BY ALL)
SELECT sid AS scenario_id, attribute, grp AS "group", n AS rows, ne AS unique_entities, pos AS positive_cases, {_i('n >= 50 AND ne >= 25', 'supported')}, CASE WHEN NOT (n >= 50 AND ne >= 25) THEN 'minimum_rows_or_students' END AS suppression_reason,
 CAST(1.0 AS DOUBLE) AS alert_rate, {rd('rv / n', 'review_rate')}, {rd('rv / n', 'proportion_alerts_reviewed')}, {rd('er', 'equal_presentation_weighted_review_rate')}, {rd('rv / n', 'row_count_weighted_review_rate')}, cp AS contributing_presentations,
 {rd('md', 'median_review_delay')}, {rd('(n - rv) / n', 'unresolved_at_horizon_rate')}, {rd('CASE WHEN n >= 50 AND ne >= 25 AND pos >= 10 THEN mp / pos END', 'capacity_miss_rate_future_inactive')},
 {rd('CASE WHEN n >= 50 AND ne >= 25 AND rv > 0 THEN rp / rv END', 'precision_among_reviewed')}, {rd('CASE WHEN n >= 50 AND ne >= 25 AND pos >= 10 AND we > 0 THEN early / we END', 'episode_before_start_review_rate')} FROM sg JOIN co USING (sid, attribute, grp)""",
)
def subgroup_access(spark, sf):
    _, lanes = _allocate(spark, sf)
    return tidy(R.subgroup_access(R.review_cases(lanes), labelled(spark, sf), _ATTRS))


@query(
    "c07_predictions_with_feature",
    PRED.rstrip(", ") + f" SELECT p.unit, p.period, p.entity, p.observation_day, {rd('p.calibrated_output', 'calibrated_output')}, CAST(m.current_inactivity_gap AS BIGINT) AS current_inactivity_gap FROM pred p JOIN modeling m USING (unit, period, entity, observation_day)",
)
def predictions_with_feature(spark, sf):
    p = A.saved_predictions(spark, sf).select(*OBSERVATION_KEYS, "calibrated_output")
    m = A.modeling(spark, sf).select(*OBSERVATION_KEYS, "current_inactivity_gap")
    return tidy(p.join(m, OBSERVATION_KEYS))


@query(
    "e12_percentile_rank",
    PRED.rstrip(", ") + f""" SELECT unit, period, entity, observation_day, {rd("(rank() OVER (w ORDER BY calibrated_output) - 1 + (count(*) OVER (PARTITION BY observation_day, calibrated_output) - 1) / 2.0) / (count(*) OVER w - 1)", 'percentile')} FROM pred WINDOW w AS (PARTITION BY observation_day)""",
)
def percentile_rank(spark, sf):
    p = A.saved_predictions(spark, sf).select(*OBSERVATION_KEYS, "calibrated_output")
    out = Rk.percentile_rank(p, ["observation_day"], "calibrated_output", "percentile", Rk.score_cell(F.col("calibrated_output")))
    return tidy(out.select(*OBSERVATION_KEYS, "percentile"))


@query(
    "e13_e14_f05_top_by_capacity",
    PRED.rstrip(", ") + """ SELECT unit, period, entity, observation_day FROM (SELECT *, row_number() OVER (PARTITION BY observation_day, unit, period ORDER BY calibrated_output DESC, entity) AS rn,
      greatest(floor(count(*) OVER (PARTITION BY observation_day, unit, period) * CAST(0.15 AS DOUBLE)), 1) AS k FROM pred) WHERE rn <= k""",
)
def top_by_capacity(spark, sf):
    p = A.saved_predictions(spark, sf).select(*OBSERVATION_KEYS, "calibrated_output")
    by = ["observation_day", "unit", "period"]
    sizes = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = p.join(sizes, by).withColumn("k", R.capacity_count(F.col("n"), F.lit(R.RATE), F.lit(0.15)))
    picked = Rk.top_k(
        rows, by, "k", F.lit(5000) - Rk.score_cell(F.col("calibrated_output")),
        [F.col("calibrated_output").desc(), F.col("entity")], spread="entity", eligible=F.lit(True),
    )
    return tidy(picked.where("selected").select(*OBSERVATION_KEYS))


@query(
    "e16_alert_cooldown",
    PRED + "a AS (SELECT unit, period, entity, list(observation_day ORDER BY observation_day) AS ds FROM pred WHERE f1_focused_prediction = 1 GROUP BY ALL), "
    "k AS (SELECT unit, period, entity, list_reduce(list_prepend([-1000], list_transform(ds, lambda x: [x])), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 6 THEN list_concat(acc, x) ELSE acc END) AS kept FROM a) "
    "SELECT unit, period, entity, CAST(unnest(kept[2:]) AS BIGINT) AS observation_day FROM k",
)
def alert_cooldown(spark, sf):
    from tidemark.operators.alerts import cooldown_alerts

    p = A.saved_predictions(spark, sf).where("f1_focused_prediction = 1").select(*OBSERVATION_KEYS)
    return tidy(cooldown_alerts(p, ENTITY_KEYS, "observation_day", 6))
