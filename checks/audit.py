"""Subgroup audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.metrics import rd, safe_div
from checks.registry import query, tidy
from checks.tables import _INFO_LABELS
from tidemark.operators import audit as Au
from tidemark.schema import ENTITY_KEYS, OBSERVATION_KEYS, UNIT_KEYS

PRIMARY = "f1_focused"
POLICIES = ["f1_focused", "fixed", "recall_focused"]


def labelled(spark, sf):
    return Au.labelled_attributes(A.info(spark, sf), ["segment", "region", "age_band"], "attempts", "credits")


def joined(spark, sf):
    return Au.join_attributes(A.saved_predictions(spark, sf), labelled(spark, sf), A.ATTRIBUTES)


def metrics(spark, sf):
    return Au.group_metrics(joined(spark, sf), A.ATTRIBUTES, POLICIES)


_LAB = _INFO_LABELS[_INFO_LABELS.index("b AS (SELECT list_sort"):].replace("FROM roster ro", "FROM roster ro")
UNK = "'Unknown / Not recorded'"
JOINED = (
    "WITH " + A.PREDICTIONS + A.INFO + ",\n" + _LAB
    + ", aud AS (SELECT p.*, " + ", ".join(f"coalesce(l.{a}, {UNK}) AS {a}" for a in A.ATTRIBUTES)
    + " FROM pred p LEFT JOIN labelled l USING (unit, period, entity))"
)

_NAMES = list(Au.METRICS)


def group_sql(name: str, keys: str, source: str, policies: list[str], rows: int, ents: int, pos: int, neg: int) -> str:
    """CTEs ``<name>c`` (counts) and ``<name>`` (suppressed metrics) over a long source."""
    per = " UNION ALL ".join(
        f"""SELECT {keys}, '{p}' AS threshold_policy, count(*) AS n, count(DISTINCT entity) AS ne, sum(actual_label) AS pos, count(*) - sum(actual_label) AS neg,
      count(*) FILTER (WHERE actual_label = 1 AND {p}_prediction = 1) AS tp, count(*) FILTER (WHERE actual_label = 0 AND {p}_prediction = 1) AS fp,
      count(*) FILTER (WHERE actual_label = 1 AND {p}_prediction = 0) AS fn, count(*) FILTER (WHERE actual_label = 0 AND {p}_prediction = 0) AS tn,
      avg(calibrated_output) AS ms, avg((calibrated_output - actual_label) ** 2) AS bs FROM {source} GROUP BY ALL"""
        for p in policies
    )
    sup = f"(n >= {rows} AND ne >= {ents})"
    raw = {
        "outcome_prevalence": "pos / n", "warning_rate": "(tp + fp) / n", "recall": safe_div("tp", "pos"), "false_negative_rate": safe_div("fn", "pos"),
        "specificity": safe_div("tn", "neg"), "false_positive_rate": safe_div("fp", "neg"), "precision": safe_div("tp", "tp + fp"),
        "negative_predictive_value": safe_div("tn", "tn + fn"), "f1": safe_div("2 * tp", "2 * tp + fp + fn"),
        "balanced_accuracy": f"({safe_div('tp', 'pos')} + {safe_div('tn', 'neg')}) / 2", "mean_calibrated_output": "ms", "brier_score": "bs", "expected_calibration_error": "ece",
    }
    need = {"recall": f"pos >= {pos}", "false_negative_rate": f"pos >= {pos}", "specificity": f"neg >= {neg}", "false_positive_rate": f"neg >= {neg}",
            "precision": "tp + fp >= 10", "balanced_accuracy": f"pos >= {pos} AND neg >= {neg}", "brier_score": "pos > 0 AND neg > 0", "expected_calibration_error": "pos > 0 AND neg > 0"}
    cols = ", ".join(f"CASE WHEN {sup} AND {need.get(m, 'true')} THEN {e} END AS {m}" for m, e in raw.items())
    return f"""{name}b AS (SELECT {keys}, sum(g) AS ece FROM (SELECT {keys}, least(floor(calibrated_output * 10), 9) AS bin, abs(sum(calibrated_output) - sum(actual_label)) / any_value(tot) AS g
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS tot FROM {source}) GROUP BY ALL) GROUP BY ALL),
{name}c AS ({per}),
{name} AS (SELECT *, {sup} AS supported, {cols}, CASE WHEN n < {rows} AND ne < {ents} THEN 'rows<{rows};students<{ents}' WHEN n < {rows} THEN 'rows<{rows}' WHEN ne < {ents} THEN 'students<{ents}' END AS general FROM {name}c JOIN {name}b USING ({keys}))"""


def long_sql(extra: str = "") -> str:
    cols = f"observation_day{extra}, entity, actual_label, calibrated_output, " + ", ".join(f"{p}_prediction" for p in POLICIES)
    return "lg AS (" + " UNION ALL ".join(f"SELECT {cols}, '{a}' AS attribute, {a} AS grp FROM aud" for a in A.ATTRIBUTES) + ")"


GM = JOINED + ", " + long_sql() + ", " + group_sql("gm", "observation_day, attribute, grp", "lg", POLICIES, 50, 25, 10, 10)
_COUNT_SEL = "n AS rows, ne AS unique_entities, CAST(pos AS BIGINT) AS positive_cases, CAST(neg AS BIGINT) AS negative_cases, tp + fp AS warning_count, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, CAST(supported AS BIGINT) AS supported"
_MET_SEL = ", ".join(rd(m, m) for m in _NAMES)
_RECALL_REASON = "nullif(concat_ws(';', general, CASE WHEN pos < {p} THEN 'positives<{p}' END, CASE WHEN pos = 0 THEN 'zero_denominator' END), '') AS reason_recall"
_KEEP = ["rows", "unique_entities", "positive_cases", "negative_cases", "warning_count", "true_positives", "false_positives", "false_negatives", "true_negatives", "supported", *_NAMES, "reason_recall"]


@query(
    "c08_attribute_join",
    JOINED + " SELECT unit, period, entity, observation_day, " + ", ".join(A.ATTRIBUTES) + " FROM aud",
)
def attribute_join(spark, sf):
    return joined(spark, sf).select(*OBSERVATION_KEYS, *A.ATTRIBUTES)


@query(
    "c14_preferred_attributes",
    "WITH " + A.ROSTER + A.INFO + """, a AS (SELECT * FROM info WHERE entity % 2 = 0), b AS (SELECT * REPLACE ('fallback' AS region) FROM info WHERE entity % 3 <> 0)
SELECT unit, period, entity, CASE WHEN a.entity IS NOT NULL THEN (CASE WHEN trim(a.segment) IN ('', '?') THEN 'Unknown / Not recorded' ELSE a.segment END) ELSE (CASE WHEN trim(b.segment) IN ('', '?') THEN 'Unknown / Not recorded' ELSE b.segment END) END AS segment,
 CASE WHEN a.entity IS NOT NULL THEN (CASE WHEN trim(a.region) IN ('', '?') THEN 'Unknown / Not recorded' ELSE a.region END) ELSE b.region END AS region
FROM a FULL JOIN b USING (unit, period, entity)""",
)
def preferred(spark, sf):
    info = A.info(spark, sf)
    return Au.preferred_attributes(
        info.where("entity % 2 = 0"), info.where("entity % 3 <> 0").withColumn("region", F.lit("fallback")), ["segment", "region"]
    )


@query(
    "d26_group_metrics",
    GM + f" SELECT observation_day, attribute, grp AS \"group\", threshold_policy, {_COUNT_SEL}, {_MET_SEL}, {_RECALL_REASON.format(p=10)} FROM gm",
)
def group_metrics(spark, sf):
    return tidy(metrics(spark, sf), ["observation_day", "attribute", "group", "threshold_policy", *_KEEP])


_REF = f""", rf AS (SELECT observation_day, attribute, threshold_policy, grp AS reference_group, n AS ref_n, {', '.join(f'{m} AS ref_{m}' for m in _NAMES)} FROM (
  SELECT *, row_number() OVER (PARTITION BY observation_day, attribute, threshold_policy ORDER BY n DESC, grp) AS rn FROM gm WHERE supported) WHERE rn = 1),
gr AS (SELECT * FROM gm LEFT JOIN rf USING (observation_day, attribute, threshold_policy))"""
_GAPS = _REF + ", gaps AS (" + " UNION ALL ".join(
    f"SELECT observation_day, threshold_policy, attribute, grp, reference_group, '{m}' AS metric, {m} AS v, ref_{m} AS r FROM gr" for m in Au.DISPARITY_METRICS
) + ")"
_DISP = (
    GM + _GAPS
    + f""", disp AS (SELECT 'group_minus_reference' AS analysis_type, observation_day, threshold_policy, attribute, grp, reference_group, metric, v - r AS value, CASE WHEN v > 0 AND r > 0 THEN v / r END AS max_min_ratio, CAST(NULL AS BIGINT) AS supported_groups FROM gaps
UNION ALL SELECT 'pairwise_range', observation_day, threshold_policy, attribute, NULL, reference_group, metric, CASE WHEN count(v) > 1 THEN max(v) - min(v) END, CASE WHEN count(v) > 1 AND min(v) > 0 THEN max(v) / min(v) END, count(v) FROM gaps GROUP BY ALL
UNION ALL SELECT 'equalized_odds_diagnostic', observation_day, threshold_policy, attribute, grp, reference_group, 'max_abs_recall_or_fpr_difference',
  CASE WHEN recall - ref_recall IS NOT NULL AND false_positive_rate - ref_false_positive_rate IS NOT NULL THEN greatest(abs(recall - ref_recall), abs(false_positive_rate - ref_false_positive_rate)) END, NULL, NULL FROM gr)
"""
)


@query(
    "c17_d27_disparities",
    _DISP + f"SELECT analysis_type, observation_day, threshold_policy, attribute, grp AS \"group\", reference_group, metric, {rd('value', 'value')}, {rd('max_min_ratio', 'max_min_ratio')}, supported_groups FROM disp",
)
def disparities(spark, sf):
    out = Au.disparities(metrics(spark, sf))
    return tidy(out, ["analysis_type", "observation_day", "threshold_policy", "attribute", "group", "reference_group", "metric", "value", "max_min_ratio", "supported_groups"])


@query("f06_reference_groups", GM + _REF + "SELECT DISTINCT observation_day, threshold_policy, attribute, reference_group FROM gr")
def reference_groups(spark, sf):
    return tidy(Au.reference_groups(metrics(spark, sf)))


_SMALL = Au.Support(10, 5, 2, 2, 2)
_ADJ = (
    JOINED + ", " + long_sql() + ", " + group_sql("gm", "observation_day, attribute, grp", "lg", ["f1_focused"], 50, 25, 10, 10) + _REF
    + ", " + long_sql(", unit, period").replace("lg AS", "lc AS")
    + ", " + group_sql("cm", "observation_day, unit, period, attribute, grp", "lc", ["f1_focused"], 10, 5, 2, 2).replace("tp + fp >= 10", "tp + fp >= 2")
    + ", cd AS (" + " UNION ALL ".join(
        f"SELECT c.observation_day, c.attribute, c.grp, r.reference_group, '{m}' AS metric, c.{m} - b.{m} AS d, c.n + b.n AS w FROM cm c JOIN rf r USING (observation_day, attribute) JOIN cm b ON b.observation_day = c.observation_day AND b.unit = c.unit AND b.period = c.period AND b.attribute = c.attribute AND b.grp = r.reference_group WHERE c.grp <> r.reference_group"
        for m in Au.ADJUSTED_METRICS
    ) + ")"
)


@query(
    "d28_course_adjusted",
    _ADJ + f" SELECT observation_day, attribute, grp AS \"group\", metric, reference_group, count(*) AS contributing_presentations, {rd('avg(d)', 'equal_presentation_difference')}, {rd('sum(d * w) / sum(w)', 'row_weighted_difference')} FROM cd WHERE d IS NOT NULL GROUP BY ALL",
)
def course_adjusted(spark, sf):
    rows = joined(spark, sf)
    overall = Au.group_metrics(rows, A.ATTRIBUTES, [PRIMARY])
    return tidy(Au.course_adjusted(rows, overall, A.ATTRIBUTES, PRIMARY, _SMALL))


_INTER = JOINED + ", li AS (" + " UNION ALL ".join(
    f"SELECT *, '{a} x {b}' AS intersection, {a} AS left_group, {b} AS right_group FROM aud" for a, b in A.PAIRS
) + "), " + group_sql("im", "observation_day, intersection, left_group, right_group", "li", ["f1_focused"], 100, 50, 15, 15)


@query(
    "d29_intersections",
    _INTER + f" SELECT observation_day, intersection, left_group, right_group, left_group || ' | ' || right_group AS \"group\", threshold_policy, {_COUNT_SEL}, {_MET_SEL}, {_RECALL_REASON.format(p=15)} FROM im",
)
def intersections(spark, sf):
    out = Au.intersection_metrics(joined(spark, sf), A.PAIRS, PRIMARY)
    return tidy(out, ["observation_day", "intersection", "left_group", "right_group", "group", "threshold_policy", *_KEEP])


_MISS = JOINED + ", " + long_sql() + f", ls AS (SELECT *, CASE WHEN grp = {UNK} THEN 'missing' ELSE 'recorded' END AS recording_status FROM lg), " + group_sql(
    "mm", "observation_day, attribute, recording_status", "ls", ["f1_focused"], 50, 25, 10, 10
) + """, sk AS (SELECT DISTINCT observation_day, attribute, st AS recording_status FROM lg, (VALUES ('missing'), ('recorded')) v(st))
SELECT observation_day, attribute, recording_status, CAST(sum(CASE WHEN recording_status = 'missing' THEN coalesce(n, 0) ELSE 0 END) OVER w AS BIGINT) AS missing_count,
 """ + rd("sum(CASE WHEN recording_status = 'missing' THEN coalesce(n, 0) ELSE 0 END) OVER w / sum(coalesce(n, 0)) OVER w", "missing_rate") + ", coalesce(n, 0) AS rows, coalesce(ne, 0) AS unique_entities, " + ", ".join(
    rd(m, m) for m in ("outcome_prevalence", "warning_rate", "recall", "false_positive_rate")
) + " FROM sk LEFT JOIN mm USING (observation_day, attribute, recording_status) WINDOW w AS (PARTITION BY observation_day, attribute)"


@query("d30_missingness", _MISS)
def missingness(spark, sf):
    return tidy(Au.missingness(joined(spark, sf), A.ATTRIBUTES, PRIMARY))


@query(
    "d31_policy_sensitivity",
    _DISP + f""", g AS (SELECT * FROM disp WHERE analysis_type = 'group_minus_reference')
SELECT b.observation_day, b.attribute, b.grp AS "group", b.metric, b.threshold_policy AS sensitivity_policy, {rd('a.value', 'primary_difference')}, {rd('b.value', 'sensitivity_difference')},
 CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'unsupported' WHEN a.value * b.value < 0 THEN 'reverses' WHEN a.value * b.value > 0 AND abs(b.value) > 2 * abs(a.value) THEN 'same_direction_magnitude_more_than_doubled'
  WHEN a.value * b.value > 0 THEN 'same_direction' ELSE 'zero_or_boundary' END AS direction_status
FROM g b JOIN g a ON a.observation_day = b.observation_day AND a.attribute = b.attribute AND a.grp = b.grp AND a.metric = b.metric WHERE a.threshold_policy = 'f1_focused' AND b.threshold_policy <> 'f1_focused'""",
)
def sensitivity(spark, sf):
    return tidy(Au.policy_sensitivity(Au.disparities(metrics(spark, sf)), PRIMARY))
