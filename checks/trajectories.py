"""Warning sequences, strategies and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.metrics import PRED, conf_sql, rd, safe_div
from checks.registry import query, tidy
from tidemark.operators import trajectories as Tr
from tidemark.schema import ENTITY_KEYS, UNIT_KEYS

DECISION = "f1_focused_prediction"
START, QUIET = 11, 7


def _pred(spark, sf):
    return A.saved_predictions(spark, sf)


def _traj(spark, sf):
    return Tr.trajectory_table(_pred(spark, sf), A.OBS, DECISION)


def _episodes(spark, sf):
    people = _pred(spark, sf).select(*ENTITY_KEYS)
    return Tr.inactivity_episodes(A.saved_daily(spark, sf), people, A.lengths(spark, sf), START, QUIET)


def _full(spark, sf):
    return Tr.attach_episodes(_traj(spark, sf), _episodes(spark, sf), A.OBS)


TRAJ = PRED + """wide AS (
  SELECT unit, period, entity, string_agg(CAST(f1_focused_prediction AS VARCHAR), '' ORDER BY observation_day) AS b,
    list(calibrated_output ORDER BY observation_day) AS sc, list(actual_label ORDER BY observation_day) AS yl
  FROM pred GROUP BY ALL HAVING count(*) = 4 AND count(DISTINCT observation_day) = 4),
traj AS (SELECT unit, period, entity, b AS warning_sequence, CASE instr(b, '1') WHEN 1 THEN 10 WHEN 2 THEN 13 WHEN 3 THEN 16 WHEN 4 THEN 19 END AS first_warning_day,
  b = '0000' AS never_warned, length(replace(b, '0', '')) AS warning_count,
  CASE WHEN b LIKE '%1111%' THEN 4 WHEN b LIKE '%111%' THEN 3 WHEN b LIKE '%11%' THEN 2 WHEN b LIKE '%1%' THEN 1 ELSE 0 END AS longest_warning_run,
  b LIKE '%1' AND b LIKE '%11%' AS persisted_to_end,
  CAST(b[1] <> b[2] AS INTEGER) + CAST(b[2] <> b[3] AS INTEGER) + CAST(b[3] <> b[4] AS INTEGER) AS warning_reversals,
  CASE WHEN b = '0000' THEN 'Never warned' WHEN b LIKE '%101%' OR b LIKE '%1001%' THEN 'Recurrent warning' WHEN b LIKE '%11%' THEN 'Persistent warning'
       WHEN b IN ('1000', '0100', '0010') THEN 'Temporary warning' ELSE 'First warned Day 19' END AS primary_category,
  b LIKE '%11%' AS persistent_warning, b IN ('1000', '0100', '0010') AS temporary_warning, b LIKE '%101%' OR b LIKE '%1001%' AS recurrent_warning,
  b IN ('1010', '0101') AS alternating_warning,
  sc[2] - sc[1] > 0.05 AND sc[3] - sc[2] > 0.05 AND sc[4] - sc[3] > 0.05 AS warning_escalation,
  sc[2] - sc[1] < -0.05 AND sc[3] - sc[2] < -0.05 AND sc[4] - sc[3] < -0.05 AS warning_deescalation, sc, yl FROM wide)
"""
_FLAG_INTS = ["first_warning_day", "never_warned", "warning_count", "longest_warning_run", "persisted_to_end", "warning_reversals",
              "persistent_warning", "temporary_warning", "recurrent_warning", "alternating_warning", "warning_escalation", "warning_deescalation"]
_FLAG_SEL = "unit, period, entity, warning_sequence, primary_category, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _FLAG_INTS)

EPIS = TRAJ + f""",
ks AS (SELECT DISTINCT unit, period, entity FROM pred),
okdays AS (SELECT k.*, s AS st FROM ks k, range({START}, {29 - QUIET + 2}) r(s)
  WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.unit = k.unit AND d.period = k.period AND d.entity = k.entity AND d.day BETWEEN s AND s + {QUIET - 1})),
epi AS (SELECT k.*, min(st) AS episode_start_day FROM ks k LEFT JOIN okdays o USING (unit, period, entity) GROUP BY ALL),
full_ AS (SELECT t.*, e.episode_start_day,
  CASE WHEN first_warning_day < coalesce(e.episode_start_day, 1000) THEN first_warning_day END AS first_prior_warning_day,
  CASE WHEN first_warning_day < coalesce(e.episode_start_day, 1000) THEN 'before_start' WHEN e.episode_start_day IS NOT NULL AND first_warning_day IS NOT NULL THEN 'late' ELSE 'never_warned' END AS warning_timing
  FROM traj t JOIN epi e USING (unit, period, entity)),
fl AS (SELECT *, episode_start_day - first_prior_warning_day AS warning_lead_time FROM full_)
"""


@query(
    "e09_trajectory_flags",
    TRAJ + f"SELECT {_FLAG_SEL}, " + ", ".join(f"{rd(f'sc[{i + 1}]', f'day{d}_score')}, CAST(yl[{i + 1}] AS BIGINT) AS day{d}_label" for i, d in enumerate(A.OBS)) + " FROM traj",
)
def trajectory_flags(spark, sf):
    return tidy(_traj(spark, sf))


@query(
    "e08_inactivity_episodes",
    EPIS + f"SELECT unit, period, entity, CAST(1 AS BIGINT) AS episode_eligible, CAST(episode_start_day AS BIGINT) AS episode_start_day, CAST(episode_start_day + {QUIET - 1} AS BIGINT) AS episode_end_day FROM epi",
)
def episodes(spark, sf):
    return tidy(_episodes(spark, sf))


@query(
    "e08_episode_warning_timing",
    EPIS + "SELECT unit, period, entity, warning_sequence, CAST(episode_start_day AS BIGINT) AS episode_start_day, CAST(first_prior_warning_day AS BIGINT) AS first_prior_warning_day, CAST(warning_lead_time AS BIGINT) AS warning_lead_time, warning_timing FROM fl",
)
def episode_timing_rows(spark, sf):
    return tidy(_full(spark, sf).select(*ENTITY_KEYS, "warning_sequence", "episode_start_day", "first_prior_warning_day", "warning_lead_time", "warning_timing"))


_PAIRS = PRED + """pr AS (
  SELECT l.unit, l.period, l.entity, l.observation_day AS from_day, r.observation_day AS to_day, l.f1_focused_prediction AS fd, r.f1_focused_prediction AS td,
    l.calibrated_output AS fs, r.calibrated_output AS ts, r.actual_label AS y
  FROM pred l JOIN pred r ON l.unit = r.unit AND l.period = r.period AND l.entity = r.entity AND r.observation_day = l.observation_day + 3)
"""


def _pairs(spark, sf):
    return Tr.adjacent_pairs(_pred(spark, sf), A.OBS, DECISION)


@query(
    "c12_adjacent_pairs",
    _PAIRS + f"SELECT unit, period, entity, from_day, to_day, fd AS from_decision, td AS to_decision, {rd('fs', 'from_score')}, {rd('ts', 'to_score')}, CAST(y AS BIGINT) AS to_label FROM pr",
)
def pairs(spark, sf):
    return tidy(_pairs(spark, sf))


@query(
    "c13_disappearance_activity",
    _PAIRS + """SELECT p.unit, p.period, p.entity, p.from_day, p.to_day, count(d.day) AS activity_days_after, CAST(coalesce(sum(d.total_clicks), 0) AS BIGINT) AS clicks_after,
      CASE WHEN count(d.day) > 0 THEN 'warning disappeared with subsequent activity' ELSE 'warning disappeared without subsequent activity' END AS classification
      FROM pr p LEFT JOIN daily d ON d.unit = p.unit AND d.period = p.period AND d.entity = p.entity AND d.day > p.to_day AND d.day <= p.to_day + 7
      WHERE fd = 1 AND td = 0 GROUP BY ALL""",
)
def disappearances(spark, sf):
    return tidy(Tr.disappearances(_pairs(spark, sf), A.saved_daily(spark, sf), 7))


@query(
    "d32_transitions",
    _PAIRS + f""", g AS (SELECT from_day, to_day, fd || '->' || td AS transition, count(*) AS c, sum(y) AS pos, sum(td) AS wr, sum(y * td) AS tp, avg(ts) AS ms,
      quantile_cont(ts - fs, [0.25, 0.5, 0.75]) AS q, avg(CAST(ts - fs > 0.05 AS INTEGER)) AS inc, avg(CAST(ts - fs < -0.05 AS INTEGER)) AS dec, avg(CAST(abs(ts - fs) <= 0.05 AS INTEGER)) AS stb FROM pr GROUP BY ALL)
    SELECT from_day, to_day, transition, c AS count, {rd('c / sum(c) OVER (PARTITION BY from_day)', 'percentage')}, {rd('pos / c', 'later_positive_rate')}, {rd('ms', 'mean_later_score')},
      {rd(safe_div('tp', 'wr'), 'later_precision')}, {rd(safe_div('tp', 'pos'), 'later_recall_contribution')}, {rd('q[2]', 'median_score_change')}, {rd('q[1]', 'score_change_q1')}, {rd('q[3]', 'score_change_q3')},
      {rd('inc', 'increasing')}, {rd('dec', 'decreasing')}, {rd('stb', 'stable')} FROM g""",
)
def transitions(spark, sf):
    return tidy(Tr.transition_table(_pairs(spark, sf)))


def stability_sql(by: str, source: str = "traj") -> str:
    k = f"{by}, " if by else ""
    return f"""st AS (SELECT {k}count(*) AS trajectories, avg(CASE WHEN warning_count > 0 THEN CAST(persistent_warning AS INTEGER) END) AS warning_persistence_rate,
  avg(CAST(warning_reversals > 0 AS INTEGER)) AS warning_reversal_rate, avg(CAST(recurrent_warning AS INTEGER)) AS recurrent_warning_rate,
  avg(CAST(warning_count = 1 AS INTEGER)) AS warned_exactly_once, avg(CAST(warning_count >= 2 AS INTEGER)) AS warned_at_least_twice,
  avg(CAST(persistent_warning AS INTEGER)) AS warned_consecutively, avg((3 - warning_reversals) / 3) AS adjacent_agreement FROM {source} {'GROUP BY ALL' if by else ''})"""


_ST = ["warning_persistence_rate", "warning_reversal_rate", "recurrent_warning_rate", "warned_exactly_once", "warned_at_least_twice", "warned_consecutively", "adjacent_agreement"]


@query("d33_stability_rates", TRAJ + ", " + stability_sql("") + "SELECT trajectories, " + ", ".join(rd(c, c) for c in _ST) + " FROM st")
def stability(spark, sf):
    return tidy(Tr.stability_rates(_traj(spark, sf), [], len(A.OBS)))


@query(
    "d34_d35_agreement",
    _PAIRS + """, k AS (SELECT from_day, to_day, count(*) AS n, avg(CAST(fd = td AS INTEGER)) AS po, avg(fd) AS pa, avg(td) AS pb FROM pr GROUP BY ALL),
rk AS (SELECT from_day, to_day, rank() OVER (PARTITION BY from_day ORDER BY fs) + (count(*) OVER (PARTITION BY from_day, fs) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY from_day ORDER BY ts) + (count(*) OVER (PARTITION BY from_day, ts) - 1) / 2 AS rb FROM pr),
s AS (SELECT from_day, to_day, corr(ra, rb) AS rho FROM rk GROUP BY ALL)
SELECT from_day, to_day, n AS cohort_size, """ + rd("(po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb)))", "cohens_kappa") + ", " + rd("rho", "spearman_score_correlation") + " FROM k JOIN s USING (from_day, to_day)",
)
def agreement(spark, sf):
    return tidy(Tr.agreement(_pairs(spark, sf)))


_STATE = TRAJ + """, sd AS (
  SELECT unit, period, entity, v.d AS observation_day, v.s AS strategy, v.e AS earliest, yl[v.i] AS actual_label,
    CAST(CASE v.s WHEN 'single' THEN warning_sequence[v.i] = '1' WHEN 'two_consecutive' THEN warning_sequence[v.i - 1:v.i] = '11'
      WHEN 'two_of_three' THEN length(replace(warning_sequence[v.i - 2:v.i], '0', '')) >= 2
      ELSE warning_sequence[v.i - 1:v.i] = '11' OR (v.i = 4 AND warning_sequence[4] = '1') END AS INTEGER) AS decision
  FROM traj, (VALUES (10, 1, 'single', 10), (13, 2, 'single', 10), (16, 3, 'single', 10), (19, 4, 'single', 10), (13, 2, 'two_consecutive', 13), (16, 3, 'two_consecutive', 13),
    (19, 4, 'two_consecutive', 13), (16, 3, 'two_of_three', 16), (19, 4, 'two_of_three', 16), (13, 2, 'persistent_or_late', 13), (16, 3, 'persistent_or_late', 13), (19, 4, 'persistent_or_late', 13)) v(d, i, s, e)),
"""


@query("e11_alert_strategies", _STATE.rstrip().rstrip(",") + " SELECT unit, period, entity, CAST(observation_day AS BIGINT) AS observation_day, strategy, CAST(earliest AS BIGINT) AS earliest_possible_day, CAST(decision AS BIGINT) AS decision, CAST(actual_label AS BIGINT) AS actual_label FROM sd")
def strategies(spark, sf):
    return tidy(Tr.strategy_decisions(_traj(spark, sf), A.OBS, ENTITY_KEYS))


def outcome_sql(by: str) -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {k}observation_day"
    one = lambda c: f"max(CASE WHEN strategy = 'single' THEN {c} END) OVER ({part})"
    return _STATE + conf_sql(f"{k}observation_day, strategy, earliest", "sd", "decision") + f""", so AS (
SELECT {k}CAST(observation_day AS BIGINT) AS observation_day, strategy, n AS rows, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, tp + fp AS warnings, tp + fn AS positive_cases,
 (tp + fp) / n AS alert_rate, {safe_div('tp', 'tp + fp')} AS precision, {safe_div('tp', 'tp + fn')} AS recall, {safe_div('tn', 'tn + fp')} AS specificity, {safe_div('fp', 'fp + tn')} AS false_positive_rate,
 {safe_div('2 * tp', '2 * tp + fp + fn')} AS f1, ({safe_div('tp', 'tp + fn')} + {safe_div('tn', 'tn + fp')}) / 2 AS balanced_accuracy,
 {one('tp + fp')} - (tp + fp) AS warnings_prevented, {one('fp')} - fp AS false_positives_prevented, {one('tp')} - tp AS true_positives_lost, fn - {one('fn')} AS false_negatives_added, earliest AS earliest_possible_day FROM conf)
"""


_SO_I = ["rows", "true_positives", "false_positives", "false_negatives", "true_negatives", "warnings", "positive_cases", "warnings_prevented", "false_positives_prevented", "true_positives_lost", "false_negatives_added", "earliest_possible_day"]
_SO_D = ["alert_rate", "precision", "recall", "specificity", "false_positive_rate", "f1", "balanced_accuracy"]
_SO = ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in _SO_I] + [rd(c, c) for c in _SO_D])


@query("c18_d36_strategy_outcomes", outcome_sql("") + f"SELECT observation_day, strategy, {_SO} FROM so")
def strategy_outcomes(spark, sf):
    return tidy(Tr.strategy_outcomes(_traj(spark, sf), A.OBS))


@query("d36_strategy_outcomes_by_course", outcome_sql("unit, period") + f"SELECT unit, period, observation_day, strategy, {_SO} FROM so")
def course_outcomes(spark, sf):
    return tidy(Tr.strategy_outcomes(_traj(spark, sf), A.OBS, UNIT_KEYS))


_MM = ["alert_rate", "precision", "recall", "f1", "false_positive_rate", "false_positives_prevented", "true_positives_lost"]


@query(
    "d19_course_macro_summary",
    outcome_sql("unit, period")
    + " UNION ALL ".join(
        f"SELECT observation_day, strategy, '{m}' AS metric, {rd(f'avg({m})', 'mean')}, {rd(f'stddev_samp({m})', 'standard_deviation')}, {rd(f'quantile_cont(CAST({m} AS DOUBLE), 0.5)', 'median')}, count({m}) AS contributing FROM so GROUP BY ALL"
        for m in _MM
    ),
)
def course_macro(spark, sf):
    return tidy(Tr.course_macro_summary(Tr.strategy_outcomes(_traj(spark, sf), A.OBS, UNIT_KEYS)))


@query(
    "d37_course_trajectories",
    EPIS + ", " + stability_sql("unit, period") + f""", cs AS (SELECT unit, period, {', '.join(f"avg(CAST(warning_sequence[{i + 1}] = '1' AS INTEGER)) AS day{d}_warning_prevalence, count(*) FILTER (WHERE first_warning_day = {d}) AS first_warned_day{d}" for i, d in enumerate(A.OBS))},
 count(*) FILTER (WHERE first_warning_day IS NULL) AS first_warned_never, count(episode_start_day) AS eligible_inactivity_episodes,
 {safe_div("count(*) FILTER (WHERE episode_start_day IS NOT NULL AND warning_timing = 'before_start')", 'count(episode_start_day)')} AS episode_detection_rate,
 quantile_cont(CASE WHEN episode_start_day IS NOT NULL AND warning_timing = 'before_start' THEN warning_lead_time END, 0.5) AS median_lead_time FROM fl GROUP BY ALL)
SELECT unit, period, {', '.join(f"{rd(f'day{d}_warning_prevalence', f'day{d}_warning_prevalence')}, first_warned_day{d}" for d in A.OBS)}, first_warned_never, eligible_inactivity_episodes,
 {rd('episode_detection_rate', 'episode_detection_rate')}, {rd('median_lead_time', 'median_lead_time')}, trajectories, {', '.join(rd(c, c) for c in _ST)} FROM cs JOIN st USING (unit, period)""",
)
def course_trajectories(spark, sf):
    return tidy(Tr.course_summary(_full(spark, sf), A.OBS))


_FSD = EPIS + """, fs AS (
  SELECT f.*, s AS strategy, e AS earliest,
   CASE s WHEN 'single' THEN first_warning_day
     WHEN 'two_consecutive' THEN CASE WHEN warning_sequence LIKE '11%' THEN 13 WHEN warning_sequence LIKE '_11%' THEN 16 WHEN warning_sequence LIKE '__11' THEN 19 END
     WHEN 'two_of_three' THEN CASE WHEN length(replace(warning_sequence[1:3], '0', '')) >= 2 THEN 16 WHEN length(replace(warning_sequence[2:4], '0', '')) >= 2 THEN 19 END
     ELSE CASE WHEN warning_sequence LIKE '11%' THEN 13 WHEN warning_sequence LIKE '_11%' THEN 16 WHEN warning_sequence LIKE '___1' THEN 19 END END AS alert_day
  FROM fl f, (VALUES ('single', 10), ('two_consecutive', 13), ('two_of_three', 16), ('persistent_or_late', 13)) v(s, e))
"""


def _dist(expr: str, prefix: str, suffix: str) -> str:
    return ", ".join([
        rd(f"quantile_cont({expr}, 0.5)", f"median_{suffix}"), rd(f"avg({expr})", f"mean_{suffix}"), rd(f"quantile_cont({expr}, 0.25)", f"{prefix}_q1"),
        rd(f"quantile_cont({expr}, 0.75)", f"{prefix}_q3"), f"CAST(min({expr}) AS BIGINT) AS minimum_{suffix}", f"CAST(max({expr}) AS BIGINT) AS maximum_{suffix}"])


@query(
    "d38_confirmation_delays",
    _FSD + f"SELECT strategy, count(alert_day) AS confirmed_trajectories, {_dist('(alert_day - first_warning_day)', 'confirmation_delay', 'confirmation_delay')}, count(*) FILTER (WHERE alert_day IS NULL) AS trajectories_never_confirmed, CAST(any_value(earliest) AS BIGINT) AS earliest_valid_day FROM fs WHERE strategy <> 'single' GROUP BY ALL",
)
def delays(spark, sf):
    return tidy(Tr.confirmation_delays(_traj(spark, sf), A.OBS))


_BEF = "CASE WHEN alert_day < episode_start_day THEN {} END"


@query(
    "d39_episode_timing",
    _FSD + f"""SELECT strategy, count(episode_start_day) AS eligible_episodes, count(*) FILTER (WHERE alert_day < episode_start_day) AS warned_before_episode_start,
      count(*) FILTER (WHERE alert_day >= episode_start_day) AS warned_after_episode_start, count(*) FILTER (WHERE episode_start_day IS NOT NULL AND alert_day IS NULL) AS never_warned,
      count(*) FILTER (WHERE episode_start_day IS NULL) AS no_eligible_episode, count(*) FILTER (WHERE episode_start_day IS NULL AND alert_day IS NOT NULL) AS false_alert_trajectories_without_episode,
      {_dist(_BEF.format('episode_start_day - alert_day'), 'lead_time', 'lead_time')}, {rd('quantile_cont(' + _BEF.format('alert_day - first_warning_day') + ', 0.5)', 'median_delay_relative_to_single')},
      CAST((SELECT count(*) FROM fs WHERE strategy = 'single' AND alert_day < episode_start_day) - count(*) FILTER (WHERE alert_day < episode_start_day) AS BIGINT) AS useful_warnings_lost_relative_to_single
      FROM fs GROUP BY ALL""",
)
def timing(spark, sf):
    return tidy(Tr.episode_timing(_full(spark, sf), A.OBS))


@query(
    "d40_episode_summary",
    EPIS + """SELECT count(episode_start_day) AS eligible_episode_count, count(*) FILTER (WHERE episode_start_day IS NOT NULL AND warning_timing = 'before_start') AS warned_before_episode_start,
      count(*) FILTER (WHERE episode_start_day IS NOT NULL AND warning_timing = 'late') AS warned_after_episode_start, count(*) FILTER (WHERE episode_start_day IS NOT NULL AND warning_timing = 'never_warned') AS eligible_episode_never_warned,
      count(*) FILTER (WHERE episode_start_day IS NULL) AS no_eligible_episode, count(*) FILTER (WHERE episode_start_day IS NULL AND warning_count > 0) AS false_alert_trajectory_without_episode FROM fl""",
)
def episode_summary(spark, sf):
    return tidy(Tr.episode_summary(_full(spark, sf)))


@query("d41_sequence_histogram", TRAJ + "SELECT warning_sequence, primary_category, count(*) AS trajectories FROM traj GROUP BY ALL")
def sequence_histogram(spark, sf):
    return Tr.sequence_histogram(_traj(spark, sf))


@query("d41_first_warning_histogram", TRAJ + "SELECT coalesce(CAST(first_warning_day AS VARCHAR), 'Never') AS first_warning, count(*) AS trajectories FROM traj GROUP BY ALL")
def first_histogram(spark, sf):
    return Tr.first_warning_histogram(_traj(spark, sf))


@query(
    "e10_start_end_patterns",
    PRED + """b AS (SELECT unit, period, entity, string_agg(CAST(fixed_prediction AS VARCHAR), '' ORDER BY observation_day) AS s FROM pred GROUP BY ALL HAVING count(*) >= 2)
SELECT unit, period, entity, CASE WHEN s NOT LIKE '%0%' THEN 'consistently_high' WHEN s NOT LIKE '%1%' THEN 'consistently_low' WHEN s LIKE '0%1' THEN 'low_to_high' WHEN s LIKE '1%0' THEN 'high_to_low' ELSE 'mixed' END AS trajectory_pattern, length(s) AS observation_count FROM b""",
)
def patterns(spark, sf):
    return tidy(Tr.start_end_patterns(_pred(spark, sf), A.OBS, "fixed_prediction"))


@query(
    "e17_representative_rows",
    PRED + f"""m AS (SELECT observation_day, actual_label, fixed_prediction, quantile_cont(calibrated_output, 0.5) AS med FROM pred GROUP BY ALL),
r AS (SELECT p.*, row_number() OVER (PARTITION BY observation_day, actual_label, fixed_prediction ORDER BY round(abs(calibrated_output - med), 9), p.entity, p.unit, p.period) AS rn FROM pred p JOIN m USING (observation_day, actual_label, fixed_prediction))
SELECT observation_day, CAST(actual_label AS BIGINT) AS actual_label, CAST(fixed_prediction AS BIGINT) AS fixed_prediction, unit, period, entity, {rd('calibrated_output', 'calibrated_output')} FROM r WHERE rn = 1""",
)
def representative(spark, sf):
    by = ["observation_day", "actual_label", "fixed_prediction"]
    rows = _pred(spark, sf).select(*by, *ENTITY_KEYS, "calibrated_output")
    return tidy(Tr.representative_rows(rows, by, "calibrated_output", ["entity", "unit", "period"]))


@query(
    "e18_weighted_median",
    PRED + """g AS (SELECT observation_day, calibrated_output AS v, sum(active_days_last_7_days) AS w FROM pred WHERE active_days_last_7_days > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY observation_day ORDER BY v) AS cw, sum(w) OVER (PARTITION BY observation_day) AS tw FROM g)
SELECT observation_day, """ + rd("min(v)", "median") + " FROM c WHERE cw >= tw / 2 GROUP BY ALL",
)
def weighted_median(spark, sf):
    return tidy(Tr.weighted_median(_pred(spark, sf), ["observation_day"], "calibrated_output", "active_days_last_7_days"))
