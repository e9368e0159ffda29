"""Bootstrap intervals and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.audit import GM, JOINED, PRIMARY, _REF, joined
from checks.metrics import PRED, rd, safe_div, zero_div
from checks.registry import query, tidy
from checks.review import REVIEW, _CKP, _allocate, SCENARIOS
from checks.trajectories import DECISION, EPIS, TRAJ, _FSD, _STATE, _full, _traj
from tidemark.operators import audit as Au
from tidemark.operators import bootstrap as Bo
from tidemark.operators import drift as Dr
from tidemark.operators import resampling as Rs
from tidemark.operators import review as R
from tidemark.operators.holdout import common_cohort
from tidemark.schema import ENTITY_KEYS

B = 1000


def index_sql(name: str, source: str, keys: list[str], by: list[str], seed: int = 42) -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    md = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"{name} AS (SELECT *, row_number() OVER ({part}ORDER BY substr(md5({md}), 1, 3), {', '.join(keys)}) - 1 AS idx, count(*) OVER ({part}) AS n_ FROM {source})"


def draw_sql(name: str, indexed: str, by: list[str], seed: int = 42) -> str:
    md = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in by], "CAST(b AS VARCHAR)", "CAST(idx AS VARCHAR)"])
    cols = "".join(f"{k}, " for k in by)
    return f"{name} AS (SELECT {cols}b AS sample, CAST(('0x' || substr(md5({md}), 1, 15)) AS BIGINT) % n_ AS idx FROM {indexed}, range({B}) r(b))"


def weight_sql(name: str, source: str, keys: list[str], seed: int = 42) -> str:
    """``name`` (keys, sample, w): Poisson weights of the distinct units of ``source``, zero weights left out."""
    k = ", ".join(keys)
    md = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in keys]])
    u = "CAST({} AS UBIGINT)".format
    limits = " + ".join(f"CAST(x >= {limit} AS INTEGER)" for limit in Bo.LIMITS)
    mixed = f"SELECT {k}, b, (CAST(('0x' || substr(md5({md}), 1, 8)) AS UBIGINT) + {u('b + 1')} * {u(Bo.STEP)}) % {u(2**32)} AS x FROM (SELECT DISTINCT {k} FROM {source}), range({B}) r(b)"
    for shift, factor in ((16, Bo.MULTIPLY[0]), (15, Bo.MULTIPLY[1]), (16, 1)):
        mixed = f"SELECT {k}, b, (xor(x, x >> {shift}) * {u(factor)}) % {u(2**32)} AS x FROM ({mixed})"
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT {k}, b AS sample, {limits} AS w FROM ({mixed})) WHERE w > 0)"


def interval_sel(keys: str, source: str, samples: int = B) -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}{rd('quantile_cont(value, 0.025)', 'lower_95')}, {rd('quantile_cont(value, 0.975)', 'upper_95')}, count(value) AS valid_samples, {samples} - count(value) AS skipped_samples FROM {source} GROUP BY ALL"


_K1 = PRED + """cc AS (SELECT unit, period, entity FROM pred GROUP BY ALL HAVING count(*) = 4 AND count(DISTINCT observation_day) = 4),
co AS (SELECT p.* FROM pred p JOIN cc USING (unit, period, entity)), """ + weight_sql("wt", "cc", ["entity"]) + f"""
, bs AS (SELECT sample, observation_day, calibrated_output AS s, actual_label AS y, w FROM wt JOIN co USING (entity)),
cf AS (SELECT sample, observation_day, coalesce(sum(w) FILTER (WHERE y = 1 AND s >= 0.5), 0) AS tp, coalesce(sum(w) FILTER (WHERE y = 0 AND s >= 0.5), 0) AS fp, coalesce(sum(w) FILTER (WHERE y = 1 AND s < 0.5), 0) AS fn FROM bs GROUP BY ALL),
g AS (SELECT sample, observation_day, s, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM bs GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(q) OVER (PARTITION BY sample, observation_day) AS tq, sum(p) OVER (PARTITION BY sample, observation_day) AS tp_ FROM g WINDOW w AS (PARTITION BY sample, observation_day ORDER BY s DESC)),
rk AS (SELECT sample, observation_day, sum(p * (tq - cq + q / 2.0)) / (any_value(tq) * any_value(tp_)) AS roc_auc, sum(p * cp / (cp + cq)) / any_value(tp_) AS average_precision FROM cu GROUP BY ALL HAVING any_value(tq) > 0 AND any_value(tp_) > 0),
al_ AS (SELECT sample, observation_day, roc_auc, average_precision, {zero_div('tp', 'tp + fp')} AS precision, {zero_div('tp', 'tp + fn')} AS recall, {zero_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cf LEFT JOIN rk USING (sample, observation_day)),
lv AS ({' UNION ALL '.join(f"SELECT sample, observation_day, '{m}' AS metric, CASE WHEN roc_auc IS NOT NULL THEN {m} END AS value FROM al_" for m in ('average_precision', 'roc_auc', 'recall', 'precision', 'f1'))})
"""


@query("k01_day_metric_intervals", _K1 + interval_sel("observation_day, metric", "lv"))
def day_intervals(spark, sf):
    cohort = common_cohort(A.saved_predictions(spark, sf), A.OBS, ENTITY_KEYS)
    return tidy(Rs.day_metric_intervals(cohort, samples=B))


_K2V = {
    "outcome_prevalence": "pos / n", "warning_rate": "wn / n", "recall": safe_div("tp", "pos"), "false_positive_rate": safe_div("fp", "fp + tn"),
    "precision": safe_div("tp", "tp + fp"), "brier_score": "sq / n",
}
_SL = ["observation_day", "attribute", "grp"]
_K2 = (
    GM + _REF.replace("WHERE supported)", "WHERE supported AND threshold_policy = 'f1_focused')")
    + """, su AS (SELECT * FROM gm WHERE supported AND threshold_policy = 'f1_focused'),
es AS (SELECT l.observation_day, l.attribute, l.grp, l.entity, count(*) AS n, sum(actual_label) AS pos, sum(f1_focused_prediction) AS wn, sum(actual_label * f1_focused_prediction) AS tp, sum((1 - actual_label) * f1_focused_prediction) AS fp,
 sum((1 - actual_label) * (1 - f1_focused_prediction)) AS tn, sum((calibrated_output - actual_label) ** 2) AS sq FROM lg l SEMI JOIN su USING (observation_day, attribute, grp) GROUP BY ALL), """
    + weight_sql("wt", "es", ["entity"])
    + """, bs AS (SELECT observation_day, attribute, grp, sample, sum(n * w) AS n, sum(pos * w) AS pos, sum(wn * w) AS wn, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(tn * w) AS tn, sum(sq * w) AS sq FROM wt JOIN es USING (entity) GROUP BY ALL),
lv AS (""" + " UNION ALL ".join(
        f"SELECT b.observation_day, b.attribute, b.grp, b.sample, '{m}' AS metric, {e} AS value FROM (SELECT bs.* FROM bs JOIN su USING (observation_day, attribute, grp) WHERE su.{m} IS NOT NULL) b"
        for m, e in _K2V.items()
    ) + """),
gp AS (SELECT l.observation_day, l.attribute, l.grp, l.metric, r.reference_group, l.value - b.value AS value FROM lv l JOIN rf r USING (observation_day, attribute) JOIN lv b ON b.observation_day = l.observation_day AND b.attribute = l.attribute AND b.grp = r.reference_group AND b.metric = l.metric AND b.sample = l.sample
 WHERE l.grp <> r.reference_group AND l.metric IN ('recall', 'false_positive_rate', 'warning_rate', 'brier_score')),
un AS (SELECT 'group' AS interval_type, observation_day, attribute, grp AS "group", CAST(NULL AS VARCHAR) AS reference_group, metric, value FROM lv UNION ALL SELECT 'group_minus_reference', observation_day, attribute, grp, reference_group, metric, value FROM gp)
"""
)


@query("k02_group_intervals", _K2 + interval_sel('interval_type, observation_day, attribute, "group", reference_group, metric', "un"))
def group_intervals(spark, sf):
    rows = joined(spark, sf)
    metrics = Au.group_metrics(rows, A.ATTRIBUTES, ["f1_focused"])
    return tidy(Rs.group_intervals(rows, metrics, A.ATTRIBUTES, PRIMARY, samples=B))


def _strategy_long(draws: str, skip: bool) -> str:
    """Per-sample strategy values from drawn trajectories ``dt``."""
    where = "WHERE observation_day > 10" if skip else ""
    return f"""sb AS (SELECT d.sample, s.observation_day, s.strategy, sum(d.w * s.actual_label * s.decision) AS tp, sum(d.w * (1 - s.actual_label) * s.decision) AS fp, sum(d.w * s.actual_label * (1 - s.decision)) AS fn FROM {draws} d JOIN sd s USING (unit, period, entity) GROUP BY ALL),
sx AS (SELECT *, max(CASE WHEN strategy = 'single' THEN fp END) OVER w - fp AS fpp, max(CASE WHEN strategy = 'single' THEN tp END) OVER w - tp AS tpl FROM sb WINDOW w AS (PARTITION BY sample, observation_day)),
sl AS (""" + " UNION ALL ".join(
        f"SELECT sample, strategy, CAST(observation_day AS BIGINT) AS observation_day, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM sx {where}"
        for m, e in (("precision", safe_div("tp", "tp + fp")), ("recall", safe_div("tp", "tp + fn")), ("f1", safe_div("2 * tp", "2 * tp + fp + fn")), ("false_positives_prevented", "fpp"), ("true_positives_lost", "tpl"))
    ) + ")"


def _in(condition: str) -> str:
    """Weight of the rows that meet a condition."""
    return f"coalesce(sum(w) FILTER (WHERE {condition}), 0)"


_NULLS = "CAST(NULL AS VARCHAR) AS strategy, CAST(NULL AS BIGINT) AS observation_day"
_K3 = (
    _STATE + weight_sql("wt", "traj", ENTITY_KEYS)
    + ", dt AS (SELECT sample, w, traj.* FROM wt JOIN traj USING (unit, period, entity)), " + _strategy_long("dt", True)
    + f""", pv AS (SELECT sample, {safe_div(_in('persistent_warning'), _in('warning_count > 0'))} AS a, {_in('warning_reversals > 0')} / sum(w) AS b, {_in('recurrent_warning')} / sum(w) AS c FROM dt GROUP BY ALL),
lv AS (SELECT strategy, observation_day, metric, value FROM sl UNION ALL SELECT {_NULLS}, 'warning_persistence_rate', a FROM pv UNION ALL SELECT {_NULLS}, 'warning_reversal_rate', b FROM pv UNION ALL SELECT {_NULLS}, 'recurrent_warning_rate', c FROM pv)
"""
)


@query("k03_trajectory_intervals", _K3 + interval_sel("strategy, observation_day, metric", "lv"))
def trajectory_intervals(spark, sf):
    return tidy(Rs.trajectory_intervals(_traj(spark, sf), A.OBS, samples=B))


def _wmed(draws: str, source: str, keys: str, by: str, name: str, weight: str = "count(*)") -> str:
    return f"""{name}g AS (SELECT d.sample, {by}, v.value, {weight} AS w FROM {draws} d JOIN {source} v USING ({keys}) WHERE v.value IS NOT NULL GROUP BY ALL),
{name}c AS (SELECT *, sum(w) OVER (PARTITION BY sample, {by} ORDER BY value) AS c, sum(w) OVER (PARTITION BY sample, {by}) AS t FROM {name}g),
{name} AS (SELECT sample, {by}, CAST(min(value) AS DOUBLE) AS value FROM {name}c WHERE c >= t / 2 GROUP BY ALL)"""


def _k4(unit: str, keys: list[str]) -> str:
    strict = unit == "strict_student_id"
    join = "unit, period, entity" if not strict else "entity"
    plain = {f"first_warning_day_{d}": f"{_in(f'first_warning_day = {d}')} / sum(w)" for d in A.OBS}
    plain["never_warned"] = f"{_in('never_warned')} / sum(w)"
    if strict:
        plain |= {
            "persistence": safe_div(_in("persistent_warning"), _in("warning_count > 0")),
            "reversal": f"{_in('warning_reversals > 0')} / sum(w)",
            "recurrence": f"{_in('recurrent_warning')} / sum(w)",
        }
    p = "s" if strict else "t"
    parts = [
        weight_sql(f"wt{p}", "traj", keys),
        f"dt{p} AS (SELECT d.sample, d.w, t.* FROM wt{p} d JOIN traj t USING ({join}))",
        f"pv{p} AS (SELECT sample, {', '.join(f'{e} AS {m}' for m, e in plain.items())} FROM dt{p} GROUP BY ALL)",
        _wmed(f"dt{p}", "dv", "unit, period, entity", "strategy, metric", f"wm{p}", "sum(d.w)"),
    ]
    union = " UNION ALL ".join(f"SELECT {_NULLS}, '{m}' AS metric, {m} AS value FROM pv{p}" for m in plain)
    union += f" UNION ALL SELECT strategy, NULL, metric, value FROM wm{p}"
    if strict:
        parts.append(_strategy_long(f"dt{p}", False))
        union += " UNION ALL SELECT strategy, observation_day, metric, value FROM sl"
    parts.append(f"lv{p} AS (SELECT '{unit}' AS bootstrap_unit, * FROM ({union}))")
    return ", ".join(parts)


_K4 = (
    _FSD + _STATE[_STATE.index(", sd AS ("):].rstrip().rstrip(",")
    + """, dv AS (SELECT unit, period, entity, strategy, 'median_episode_lead_time' AS metric, CASE WHEN alert_day < episode_start_day THEN episode_start_day - alert_day END AS value FROM fs
  UNION ALL SELECT unit, period, entity, strategy, 'confirmation_delay', alert_day - first_warning_day FROM fs WHERE strategy <> 'single'), """
    + _k4("student_course_trajectory", ENTITY_KEYS) + ", " + _k4("strict_student_id", ["entity"])
    + ", un AS (SELECT * FROM lvt UNION ALL SELECT * FROM lvs) SELECT * FROM ("
    + interval_sel("bootstrap_unit, strategy, observation_day, metric", "un") + ") WHERE valid_samples > 0"
)


@query("k04_reporting_intervals", _K4)
def reporting_intervals(spark, sf):
    return tidy(Rs.reporting_intervals(_full(spark, sf), A.OBS, samples=B))


def _k5(unit: str, keys: list[str]) -> str:
    p = "s" if unit == "student_id" else "t"
    join = ", ".join(keys)
    sums = ["raw_alerts", "positives", "reviewed", "reviewed_positive", "unreviewed_positive", "unresolved", "case_count", "episode", "episode_before"]
    vals = {
        "proportion_alerts_reviewed": safe_div("reviewed", "raw_alerts"), "capacity_utilization": "cu", "future_inactive_capture_rate": safe_div("reviewed_positive", "positives"),
        "capacity_miss_rate": safe_div("unreviewed_positive", "positives"), "unresolved_at_horizon_rate": safe_div("unresolved", "case_count"), "episode_before_start_review_rate": safe_div("episode_before", "episode"),
    }
    return ", ".join([
        index_sql(f"ix{p}", f"(SELECT DISTINCT {join} FROM evs)", keys, []),
        draw_sql(f"dr{p}", f"ix{p}", []),
        f"du{p} AS (SELECT d.sample, {', '.join('i.' + k for k in keys)} FROM dr{p} d JOIN ix{p} i USING (idx))",
        f"sm{p} AS (SELECT sid, sample, any_value(cu) AS cu, {', '.join(f'sum({c}) AS {c}' for c in sums)} FROM du{p} JOIN rec USING ({join}) GROUP BY ALL)",
        _wmed(f"du{p}", "dv", join, "sid, metric", f"wm{p}"),
        f"lv{p} AS (SELECT '{unit}' AS bootstrap_unit, * FROM (" + " UNION ALL ".join(f"SELECT sid, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM sm{p}" for m, e in vals.items()) + f" UNION ALL SELECT sid, metric, value FROM wm{p}))",
    ])


_K5 = (
    _CKP + f""", pick AS (SELECT s.sid, {safe_div('sum(rv)', 'sum(av)')} AS cu FROM scen s JOIN ckp USING (sid) WHERE s.pol = 'f1_focused' AND s.dd = 'open_case' AND s.ck IN ('rate', 'unlimited') GROUP BY ALL),
pc AS (SELECT sid, unit, period, entity, count(review_day) AS reviewed, count(*) FILTER (WHERE review_day IS NOT NULL AND ol = 1) AS reviewed_positive, count(*) FILTER (WHERE review_day IS NULL AND ol = 1) AS unreviewed_positive, count(*) FILTER (WHERE review_day IS NULL) AS unresolved,
  count(*) AS case_count, max(CASE WHEN review_day < episode_start_day THEN 1 ELSE 0 END) AS episode_before FROM cs GROUP BY ALL),
pe_ AS (SELECT unit, period, entity, sum(f1_focused_prediction) AS raw_alerts, sum(actual_label) AS positives, max(CASE WHEN episode_start_day IS NULL THEN 0 ELSE 1 END) AS episode FROM evs GROUP BY ALL),
rec AS (SELECT k.sid, k.cu, e.*, coalesce(reviewed, 0) AS reviewed, coalesce(reviewed_positive, 0) AS reviewed_positive, coalesce(unreviewed_positive, 0) AS unreviewed_positive, coalesce(unresolved, 0) AS unresolved, coalesce(case_count, 0) AS case_count, coalesce(episode_before, 0) AS episode_before
  FROM pick k CROSS JOIN pe_ e LEFT JOIN pc c ON c.sid = k.sid AND c.unit = e.unit AND c.period = e.period AND c.entity = e.entity),
dv AS (SELECT sid, unit, period, entity, 'median_review_delay' AS metric, review_day - origin AS value FROM cs SEMI JOIN pick USING (sid) WHERE review_day IS NOT NULL
  UNION ALL SELECT sid, unit, period, entity, 'median_useful_lead_time', CASE WHEN review_day < episode_start_day THEN episode_start_day - review_day END FROM cs SEMI JOIN pick USING (sid) WHERE review_day IS NOT NULL), """
    + _k5("student_course_trajectory", ENTITY_KEYS) + ", " + _k5("student_id", ["entity"])
    + ", un AS (SELECT sid AS scenario_id, * EXCLUDE (sid) FROM lvt UNION ALL SELECT sid, * EXCLUDE (sid) FROM lvs) SELECT * FROM ("
    + interval_sel("bootstrap_unit, scenario_id, metric", "un") + ") WHERE valid_samples > 0"
)


@query("k05_workload_intervals", _K5)
def workload_intervals(spark, sf):
    from tidemark.plans.audits import workload_comparison
    from checks.review import events

    rows = events(spark, sf)
    out = workload_comparison(rows, SCENARIOS, A.OBS, A.STEP)
    return tidy(Rs.workload_intervals(out["cases"], rows, out["scenarios"], samples=B))


# ---------------------------------------------------------------- drift

_DF = ["historical_average_clicks", "click_z_score", "current_inactivity_gap", "longest_previous_inactivity_gap"]


def _profile_sql(name: str, where: str) -> str:
    lf = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM pred WHERE {where}" for f in _DF)
    return f"""{name}l AS ({lf}), {name} AS (SELECT feature, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, [0.25, 0.5, 0.75]) AS q, min(v) AS mn, max(v) AS mx FROM {name}l GROUP BY ALL)"""


@query(
    "d42_feature_profile",
    PRED + _profile_sql("pf", "observation_day = 10") + f""", hb AS (SELECT feature, least(floor((v - mn) / (mx - mn) * 10), 9) AS b, count(*) AS c FROM pfl JOIN pf USING (feature) WHERE v IS NOT NULL GROUP BY ALL),
hs AS (SELECT f.feature, string_agg(CAST(coalesce(c, 0) AS VARCHAR), ',' ORDER BY i) AS histogram FROM (SELECT feature, i FROM pf, range(10) r(i)) f LEFT JOIN hb ON hb.feature = f.feature AND hb.b = f.i GROUP BY ALL)
SELECT feature, {rd('missing_rate', 'missing_rate')}, {rd('mean', 'mean')}, {rd('std', 'std')}, {rd('q[2]', 'median')}, {rd('q[1]', 'q1')}, {rd('q[3]', 'q3')}, {rd('mn', 'min')}, {rd('mx', 'max')}, histogram FROM pf JOIN hs USING (feature)""",
)
def feature_profile(spark, sf):
    return tidy(Dr.feature_profile(A.saved_predictions(spark, sf).where("observation_day = 10"), _DF))


_SQ = ", ".join(rd(f"quantile_cont(calibrated_output, {q})", f"q{round(q * 100)}") for q in Dr.SCORE_QUANTILES)
_HIST = "array_to_string(list_transform(range(10), lambda i: len(list_filter(list(calibrated_output), lambda x: least(floor(x * 10), 9) = i))), ',') AS histogram"


@query(
    "d42_score_profile",
    PRED.rstrip(", ") + f" SELECT {rd('avg(calibrated_output)', 'mean')}, {rd('quantile_cont(calibrated_output, 0.5)', 'median')}, {rd('stddev_pop(calibrated_output)', 'std')}, {_SQ}, {_HIST}, {rd('avg(CAST(calibrated_output >= 0.5 AS INTEGER))', 'share_above_threshold')} FROM pred WHERE observation_day = 10",
)
def score_profile(spark, sf):
    return tidy(Dr.score_profile(A.saved_predictions(spark, sf).where("observation_day = 10"), "calibrated_output"))


_DRIFT = PRED + _profile_sql("pf", "observation_day = 10") + ", " + _profile_sql("cu", "observation_day = 19") + """, orr AS (SELECT l.feature, avg(CASE WHEN v IS NOT NULL THEN CAST(v < mn OR v > mx AS INTEGER) END) AS o FROM cul l JOIN pf USING (feature) GROUP BY ALL),
dd AS (SELECT c.feature, c.missing_rate, p.missing_rate AS rm, CASE WHEN p.std <> 0 THEN (c.mean - p.mean) / p.std END AS smd, c.q[2] - p.q[2] AS ms, o FROM cu c JOIN pf p USING (feature) JOIN orr USING (feature))
"""
_LEVEL = "CASE WHEN abs(smd) >= 1 THEN 'critical' WHEN abs(smd) >= 0.5 THEN 'warning' ELSE 'informational' END"


@query(
    "d43_feature_drift",
    _DRIFT + f"SELECT feature, {rd('missing_rate', 'missing_rate')}, {rd('rm', 'reference_missing_rate')}, {rd('missing_rate - rm', 'missing_rate_difference')}, {rd('smd', 'standardized_mean_difference')}, {rd('ms', 'median_shift')}, {rd('o', 'out_of_range_rate')}, {_LEVEL} AS level FROM dd",
)
def feature_drift(spark, sf):
    p = A.saved_predictions(spark, sf)
    profile = Dr.feature_profile(p.where("observation_day = 10"), _DF)
    return tidy(Dr.feature_drift(p.where("observation_day = 19"), profile, _DF))


@query(
    "d44_score_drift",
    PRED + f"""h AS (SELECT observation_day AS od, least(floor(calibrated_output * 10), 9) AS b, count(*) AS c FROM pred WHERE observation_day IN (10, 19) GROUP BY ALL),
sh AS (SELECT i, coalesce(max(CASE WHEN od = 10 THEN c END), 0) / (SELECT sum(c) FROM h WHERE od = 10) AS r, coalesce(max(CASE WHEN od = 19 THEN c END), 0) / (SELECT sum(c) FROM h WHERE od = 19) AS k FROM range(10) g(i) LEFT JOIN h ON h.b = i GROUP BY ALL),
ps AS (SELECT sum((k - r) * ln((k + 1e-6) / (r + 1e-6))) AS psi FROM sh)
SELECT {rd('avg(calibrated_output)', 'mean')}, {rd('quantile_cont(calibrated_output, 0.5)', 'median')}, {rd('stddev_pop(calibrated_output)', 'std')}, {_SQ}, {_HIST}, {rd('avg(CAST(calibrated_output >= 0.5 AS INTEGER))', 'share_above_threshold')}, {rd('(SELECT psi FROM ps)', 'psi')} FROM pred WHERE observation_day = 19""",
)
def score_drift(spark, sf):
    p = A.saved_predictions(spark, sf)
    return tidy(Dr.score_drift(p.where("observation_day = 19"), p.where("observation_day = 10"), "calibrated_output"))


from checks.metrics import conf_sql, rank_sql  # noqa: E402


@query(
    "d45_delayed_performance",
    PRED + "b1 AS (SELECT *, 'all' AS sl FROM pred WHERE observation_day = 19), " + conf_sql("sl", "b1", "fixed_prediction") + ", " + rank_sql(["sl"], "b1")
    + f""", mb AS (SELECT sl, least(floor(calibrated_output * 10), 9) AS bin, count(*) AS n, avg(calibrated_output) AS s, avg(actual_label) AS y FROM b1 GROUP BY ALL), me AS (SELECT sl, sum(n * abs(s - y)) / sum(n) AS ece FROM mb GROUP BY ALL)
SELECT {rd('(tp + fn) / n', 'prevalence')}, {rd('average_precision', 'pr_auc')}, {rd('roc_auc', 'roc_auc')}, {rd('brier_score', 'brier')}, {rd('ece', 'expected_calibration_error')}, {rd(zero_div('tp', 'tp + fp'), 'precision')}, {rd(zero_div('tp', 'tp + fn'), 'recall')},
 {rd(zero_div('2 * tp', '2 * tp + fp + fn'), 'f1')}, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives, {rd('(tp + fp) / n', 'alert_rate')} FROM conf JOIN auc USING (sl) JOIN ap USING (sl) JOIN loss USING (sl) JOIN me USING (sl)""",
)
def delayed_performance(spark, sf):
    p = A.saved_predictions(spark, sf).where("observation_day = 19")
    return tidy(Dr.delayed_performance(p, "calibrated_output", "actual_label", aligned=True))


@query("m12_drift_alert_counts", _DRIFT + f"SELECT {_LEVEL} AS level, count(*) AS features FROM dd GROUP BY ALL")
def drift_counts(spark, sf):
    p = A.saved_predictions(spark, sf)
    profile = Dr.feature_profile(p.where("observation_day = 10"), _DF)
    return Dr.alert_counts(Dr.feature_drift(p.where("observation_day = 19"), profile, _DF))
