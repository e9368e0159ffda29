"""Metrics, thresholds, summaries, holdouts, folds and shift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import adapter as A
from checks.registry import query, tidy
from tidemark.operators import holdout as H
from tidemark.operators import metrics as X
from tidemark.operators import shift as Sh
from tidemark.operators import summaries as Su
from tidemark.operators import thresholds as Th
from tidemark.schema import ENTITY_KEYS, OBSERVATION_KEYS

DAY = ["observation_day"]
SLICE = ["observation_day", "outer_holdout_id"]
SCORE, LABEL = "calibrated_output", "actual_label"


def rd(expr: str, name: str) -> str:
    return f"round(round(CAST({expr} AS DOUBLE), 10), 6) + 0.0 AS {name}"


def safe_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END)"


def zero_div(a: str, b: str) -> str:
    return f"coalesce({safe_div(a, b)}, 0)"


def conf_sql(by: str, source: str, decision: str, name: str = "conf", label: str = "actual_label") -> str:
    keys = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {keys}count(*) AS n,
  count(*) FILTER (WHERE {label} = 1 AND {decision} = 1) AS tp, count(*) FILTER (WHERE {label} = 0 AND {decision} = 1) AS fp,
  count(*) FILTER (WHERE {label} = 1 AND {decision} = 0) AS fn, count(*) FILTER (WHERE {label} = 0 AND {decision} = 0) AS tn
  FROM {source} GROUP BY ALL)"""


def _keys(by: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in by)


def rank_sql(by: list[str], source: str = "pred", score: str = SCORE, label: str = LABEL) -> str:
    k = ", ".join(by)
    return f"""auc AS (SELECT {', '.join('p.' + c for c in by)}, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) AS roc_auc
  FROM (SELECT {k}, {score} AS s FROM {source} WHERE {label} = 1) p JOIN (SELECT {k}, {score} AS s FROM {source} WHERE {label} = 0) q
  ON {_keys(by, 'p', 'q')} GROUP BY ALL),
apc AS (SELECT {k}, {score} AS s, sum({label}) AS pos, count(*) AS c FROM {source} GROUP BY ALL),
apw AS (SELECT *, sum(pos) OVER w AS cp, sum(c) OVER w AS cc FROM apc WINDOW w AS (PARTITION BY {k} ORDER BY s DESC)),
ap AS (SELECT {k}, CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cc) / sum(pos) END AS average_precision FROM apw GROUP BY ALL),
loss AS (SELECT {k}, avg(({score} - {label}) * ({score} - {label})) AS brier_score,
  avg(-({label} * ln(least(greatest({score}, 1e-15), 1 - 1e-15)) + (1 - {label}) * ln(1 - least(greatest({score}, 1e-15), 1 - 1e-15)))) AS log_loss
  FROM {source} GROUP BY ALL)"""


def safe_sql(by: list[str], source: str = "pred", decision: str = "fixed_prediction", tail: bool = True) -> str:
    """CTE ``rep`` with the one-class-safe report per slice."""
    k = ", ".join(f"c.{x}" for x in by)
    join = lambda t: f"LEFT JOIN {t} ON {_keys(by, t, 'c')}"
    return f"""{conf_sql(', '.join(by), source, decision)}, {rank_sql(by, source)},
rep AS (SELECT {k}, n AS rows, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  tp + fn AS positive_rows, fp + tn AS negative_rows, (tp + fn) / n AS target_prevalence, (tp + tn) / n AS accuracy,
  ({safe_div('tp', 'tp + fn')} + {safe_div('tn', 'tn + fp')}) / 2 AS balanced_accuracy, {zero_div('tp', 'tp + fp')} AS precision,
  {safe_div('tp', 'tp + fn')} AS recall, {safe_div('tn', 'tn + fp')} AS specificity, {zero_div('2 * tp', '2 * tp + fp + fn')} AS f1,
  tp + fp AS predicted_positive_rows, {safe_div('fn', 'fn + tp')} AS false_negative_rate, {safe_div('fp', 'fp + tn')} AS false_positive_rate,
  roc_auc, average_precision, brier_score, log_loss, (tp + fn) / n AS no_skill_pr_auc, {safe_div('average_precision', '(tp + fn) / n')} AS pr_auc_lift
  FROM conf c {join('auc')} {join('ap')} {join('loss')})"""


_REP_DOUBLE = ["target_prevalence", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1",
               "false_negative_rate", "false_positive_rate", "roc_auc", "average_precision", "brier_score", "log_loss",
               "no_skill_pr_auc", "pr_auc_lift"]
_REP_INT = ["rows", "true_positives", "false_positives", "false_negatives", "true_negatives", "positive_rows",
            "negative_rows", "predicted_positive_rows"]


def rep_select(by: list[str]) -> str:
    return "SELECT " + ", ".join(by + [f"CAST({c} AS BIGINT) AS {c}" for c in _REP_INT] + [rd(c, c) for c in _REP_DOUBLE]) + " FROM rep"


PRED = "WITH " + A.PREDICTIONS + ", "


@query(
    "d11_confusion_metrics",
    PRED + conf_sql("observation_day", "pred", "fixed_prediction")
    + f"""SELECT observation_day, n AS rows, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
      {rd('(tp + tn) / n', 'accuracy')}, {rd(zero_div('tp', 'tp + fp'), 'precision')}, {rd(zero_div('tp', 'tp + fn'), 'recall')},
      {rd(zero_div('2 * tp', '2 * tp + fp + fn'), 'f1')}, tp + fp AS predicted_positive_rows FROM conf""",
)
def confusion_metrics(spark, sf):
    return tidy(X.zero_rates(X.confusion(A.saved_predictions(spark, sf), DAY, LABEL, "fixed_prediction")))


@query("d12_d20_safe_metrics_by_day", PRED + safe_sql(DAY) + rep_select(DAY))
def safe_by_day(spark, sf):
    return tidy(X.classification_report(A.saved_predictions(spark, sf), DAY, SCORE, LABEL))


@query("d12_safe_metrics_by_holdout", PRED + safe_sql(SLICE) + rep_select(SLICE))
def safe_by_holdout(spark, sf):
    return tidy(X.classification_report(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL))


@query(
    "d13_nullable_metrics",
    PRED + conf_sql("observation_day, outer_holdout_id", "pred", "alert_capacity_prediction")
    + f"""SELECT observation_day, outer_holdout_id, n AS rows, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
      tp + fp AS warnings, tp + fn AS positive_cases, {rd('(tp + fp) / n', 'alert_rate')}, {rd(safe_div('tp', 'tp + fp'), 'precision')},
      {rd(safe_div('tp', 'tp + fn'), 'recall')}, {rd(safe_div('tn', 'tn + fp'), 'specificity')}, {rd(safe_div('fp', 'fp + tn'), 'false_positive_rate')},
      {rd(safe_div('2 * tp', '2 * tp + fp + fn'), 'f1')}, {rd('(' + safe_div('tp', 'tp + fn') + ' + ' + safe_div('tn', 'tn + fp') + ') / 2', 'balanced_accuracy')} FROM conf""",
)
def nullable_metrics(spark, sf):
    return tidy(X.nullable_rates(X.confusion(A.saved_predictions(spark, sf), SLICE, LABEL, "alert_capacity_prediction")))


@query(
    "d14_d15_d16_ranking_metrics",
    PRED + rank_sql(DAY)
    + f"SELECT auc.observation_day, {rd('roc_auc', 'roc_auc')}, {rd('average_precision', 'average_precision')}, {rd('brier_score', 'brier_score')}, {rd('log_loss', 'log_loss')} FROM auc JOIN ap USING (observation_day) JOIN loss USING (observation_day)",
)
def ranking_metrics(spark, sf):
    out = X.ranking_metrics(A.saved_predictions(spark, sf), DAY, SCORE, LABEL)
    return tidy(out.select("observation_day", "roc_auc", "average_precision", "brier_score", "log_loss"))


_TEXT_SQL = (
    "WITH base AS (SELECT d.source, l.quality AS actual_label, round(1.0 / (1.0 + exp(2.0 - d.n_chars / 1000.0)), 6) AS s FROM documents d JOIN labels l USING (doc_id)), "
    + rank_sql(["source"], "base", "s")
    + f"SELECT ap.source, {rd('roc_auc', 'roc_auc')}, {rd('average_precision', 'average_precision')}, {rd('brier_score', 'brier_score')}, {rd('log_loss', 'log_loss')} FROM ap LEFT JOIN auc USING (source) LEFT JOIN loss USING (source)"
)


@query("d14_ranking_metrics_document_labels", _TEXT_SQL)
def document_ranking(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    joined = d.join(A.table(spark, sf, "labels"), "doc_id").withColumn(
        "s", F.round(1.0 / (1.0 + F.exp(2.0 - F.col("n_chars") / 1000.0)), 6)
    )
    out = X.ranking_metrics(joined, ["source"], "s", "quality")
    return tidy(out.select("source", "roc_auc", "average_precision", "brier_score", "log_loss"))


def bins_sql(by: list[str], source: str = "pred", score: str = SCORE, label: str = LABEL) -> str:
    k = ", ".join(by)
    return f"""sl AS (SELECT DISTINCT {k} FROM {source}),
bn AS (SELECT sl.*, i, i / 10.0 AS lo, (i + 1) / 10.0 AS hi FROM sl, range(10) r(i)),
bins AS (SELECT {', '.join('bn.' + c for c in by)}, bn.lo AS bin_lower, bn.hi AS bin_upper, count(p.{score}) AS row_count, avg(p.{score}) AS mean_predicted_value,
  avg(p.{label}) AS observed_positive_rate, abs(avg(p.{score}) - avg(p.{label})) AS absolute_calibration_gap
  FROM bn LEFT JOIN {source} p ON {_keys(by, 'p', 'bn')} AND p.{score} >= bn.lo AND (p.{score} < bn.hi OR (i = 9 AND p.{score} = 1)) GROUP BY ALL)"""


@query(
    "d17_calibration_bins",
    PRED + bins_sql(DAY)
    + f"SELECT observation_day, {rd('bin_lower', 'bin_lower')}, {rd('bin_upper', 'bin_upper')}, row_count, {rd('mean_predicted_value', 'mean_predicted_value')}, {rd('observed_positive_rate', 'observed_positive_rate')}, {rd('absolute_calibration_gap', 'absolute_calibration_gap')} FROM bins",
)
def calibration_bins(spark, sf):
    return tidy(X.calibration_bins(A.saved_predictions(spark, sf), DAY, SCORE, LABEL))


@query(
    "d18_calibration_errors",
    PRED + bins_sql(SLICE)
    + f"SELECT observation_day, outer_holdout_id, {rd('sum(row_count * absolute_calibration_gap) / sum(row_count)', 'expected_calibration_error')}, {rd('max(absolute_calibration_gap)', 'maximum_calibration_error')} FROM bins GROUP BY ALL",
)
def calibration_errors(spark, sf):
    bins = X.calibration_bins(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL)
    return tidy(X.calibration_errors(bins, SLICE))


@query(
    "d18_monitoring_calibration_error",
    PRED + """b AS (SELECT observation_day, least(floor(calibrated_output * 10), 9) AS bin, count(*) AS n, avg(calibrated_output) AS s, avg(actual_label) AS y FROM pred GROUP BY ALL)
SELECT observation_day, """ + rd("sum(n * abs(s - y)) / sum(n)", "expected_calibration_error") + " FROM b GROUP BY ALL",
)
def monitoring_error(spark, sf):
    return tidy(X.monitoring_calibration_error(A.saved_predictions(spark, sf), DAY, SCORE, LABEL))


_MACRO = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier_score"]


@query(
    "d19_macro_summary",
    PRED + safe_sql(SLICE)
    + " UNION ALL ".join(
        f"SELECT observation_day, '{m}' AS metric, {rd(f'avg({m})', 'mean')}, {rd(f'stddev_samp({m})', 'standard_deviation')}, {rd(f'quantile_cont({m}, 0.5)', 'median')}, count({m}) AS contributing FROM rep GROUP BY ALL"
        for m in _MACRO
    ),
)
def macro_summary(spark, sf):
    rep = X.classification_report(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL)
    return tidy(Su.macro_summary(rep, DAY, _MACRO))


_POL = ["fixed", "f1_focused", "recall_focused"]
_PAIRS = {"f1_minus_fixed": ("f1_focused", "fixed"), "recall_minus_f1": ("recall_focused", "f1_focused")}


def _policy_sql() -> str:
    parts = ", ".join(
        f"(SELECT observation_day, outer_holdout_id, '{p}' AS policy, actual_label, {p}_prediction AS decision FROM pred)" for p in _POL
    )
    union = " UNION ALL ".join(
        f"SELECT observation_day, outer_holdout_id, '{p}' AS policy, actual_label, {p}_prediction AS decision, calibrated_output, {p}_threshold AS selected_threshold FROM pred" for p in _POL
    )
    del parts
    return f"ld AS ({union}), " + conf_sql("observation_day, outer_holdout_id, policy", "ld", "decision") + f""",
pm AS (SELECT observation_day, outer_holdout_id, policy, {zero_div('tp', 'tp + fp')} AS precision, {zero_div('tp', 'tp + fn')} AS recall, {zero_div('2 * tp', '2 * tp + fp + fn')} AS f1, (tp + tn) / n AS brier_score FROM conf)"""


_PM = ["precision", "recall", "f1", "brier_score"]
_DIFF = (
    ",\ndf AS ("
    + " UNION ALL ".join(
        f"SELECT l.observation_day, l.outer_holdout_id, '{c}' AS comparison, '{m}' AS metric, l.{m} - r.{m} AS difference FROM pm l JOIN pm r USING (observation_day, outer_holdout_id) WHERE l.policy = '{a}' AND r.policy = '{b}'"
        for c, (a, b) in _PAIRS.items()
        for m in _PM
    )
    + ")"
)


def _policy_metrics(spark, sf):
    long = Th.long_decisions(A.saved_predictions(spark, sf), _POL, [*SLICE, LABEL])
    m = X.zero_rates(X.confusion(long, [*SLICE, "threshold_policy"], LABEL, "decision"))
    return m.withColumn("brier_score", F.col("accuracy"))


@query("c15_paired_differences", PRED + _policy_sql() + _DIFF + f" SELECT observation_day, outer_holdout_id, comparison, metric, {rd('difference', 'difference')} FROM df")
def paired(spark, sf):
    return tidy(Su.paired_differences(_policy_metrics(spark, sf), DAY, "outer_holdout_id", "threshold_policy", _PAIRS, _PM))


def _paired_sum_sql(flip: bool) -> str:
    g = "CASE WHEN metric = 'brier_score' THEN -difference ELSE difference END" if flip else "difference"
    return (
        PRED + _policy_sql() + _DIFF
        + f"""SELECT observation_day, comparison, metric, count(*) AS valid_holdouts, {rd('avg(difference)', 'mean_difference')}, {rd('stddev_samp(difference)', 'standard_deviation')},
      {rd('quantile_cont(difference, 0.5)', 'median_difference')}, count(*) FILTER (WHERE {g} > 0) AS left_favored, count(*) FILTER (WHERE {g} < 0) AS right_favored,
      count(*) FILTER (WHERE difference = 0) AS ties FROM df GROUP BY ALL"""
    )


@query("d21_paired_summary", _paired_sum_sql(False))
def paired_summary(spark, sf):
    d = Su.paired_differences(_policy_metrics(spark, sf), DAY, "outer_holdout_id", "threshold_policy", _PAIRS, _PM)
    return tidy(Su.paired_summary(d, DAY))


@query("d21_paired_summary_loss_aware", _paired_sum_sql(True))
def paired_summary_loss(spark, sf):
    d = Su.paired_differences(_policy_metrics(spark, sf), DAY, "outer_holdout_id", "threshold_policy", _PAIRS, _PM)
    return tidy(Su.paired_summary(d, DAY, lower_is_better=True))


_WORST = {
    "lowest_pr_auc": ("average_precision", "min"),
    "lowest_recall": ("recall", "min"),
    "lowest_precision": ("precision", "min"),
    "highest_false_negative_rate": ("false_negative_rate", "max"),
    "highest_false_positive_rate": ("false_positive_rate", "max"),
}


@query(
    "d22_worst_holdouts",
    PRED + safe_sql(SLICE)
    + " UNION ALL ".join(
        f"SELECT observation_day, '{n}' AS worst_measure, outer_holdout_id AS holdout, {rd(m, 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY observation_day ORDER BY {m} {'ASC' if s == 'min' else 'DESC'}, outer_holdout_id) AS rn FROM rep WHERE {m} IS NOT NULL) WHERE rn = 1"
        for n, (m, s) in _WORST.items()
    ),
)
def worst_holdouts(spark, sf):
    rep = X.classification_report(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL)
    return tidy(Su.worst_slices(rep, DAY, "outer_holdout_id", _WORST))


_OVERLAP = A.SEGMENTED + """, ov AS (
  SELECT p.observation_day, p.outer_holdout_id, count(*) AS test_rows, count(DISTINCT p.entity) AS test_entities FROM p0 p GROUP BY ALL),
tr AS (SELECT o.observation_day, o.outer_holdout_id, q.entity,
    q.entity IN (SELECT entity FROM p0 t WHERE t.observation_day = o.observation_day AND t.outer_holdout_id = o.outer_holdout_id) AS shared
  FROM ov o JOIN p0 q ON q.observation_day = o.observation_day AND q.outer_holdout_id <> o.outer_holdout_id),
splits AS (SELECT o.*, count(t.entity) AS training_rows, count(DISTINCT t.entity) AS training_entities, count(DISTINCT t.entity) FILTER (WHERE t.shared) AS overlapping_entities,
  count(DISTINCT t.entity) FILTER (WHERE t.shared) AS removed_entities, count(*) FILTER (WHERE t.shared) AS removed_rows,
  count(*) FILTER (WHERE NOT t.shared) AS strict_training_rows, count(DISTINCT t.entity) FILTER (WHERE NOT t.shared) AS strict_training_entities
  FROM ov o LEFT JOIN tr t USING (observation_day, outer_holdout_id) GROUP BY ALL)
"""


@query("c09_holdout_overlap", PRED + _OVERLAP + "SELECT * FROM splits")
def holdout_overlap(spark, sf):
    return tidy(H.holdout_overlap(_shift_rows(spark, sf), "outer_holdout_id"))


_SEGMENTS = [f"{s}_P{p}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for p in (0, 1)]


@query(
    "c09_strict_training_rows",
    PRED + A.SEGMENTED
    + """, te AS (SELECT DISTINCT outer_holdout_id AS held_out, entity FROM p0), ho AS (SELECT DISTINCT held_out FROM te)
SELECT h.held_out, p.unit, p.period, p.entity, p.observation_day, p.actual_label FROM ho h JOIN p0 p ON p.outer_holdout_id <> h.held_out
ANTI JOIN te ON te.held_out = h.held_out AND te.entity = p.entity""",
)
def strict_training(spark, sf):
    rows = _shift_rows(spark, sf)
    parts = [
        H.leave_one_out(rows, "outer_holdout_id", s)[0].select(F.lit(s).alias("held_out"), *OBSERVATION_KEYS, LABEL)
        for s in _SEGMENTS
    ]
    return tidy(reduce(DataFrame.unionByName, parts))


@query(
    "d23_overlap_totals",
    PRED + _OVERLAP
    + "SELECT observation_day, count(*) AS holdouts, CAST(sum(overlapping_entities) AS BIGINT) AS overlapping_entities, CAST(sum(removed_entities) AS BIGINT) AS removed_entities, CAST(sum(removed_rows) AS BIGINT) AS removed_rows FROM splits GROUP BY ALL",
)
def overlap_totals(spark, sf):
    splits = H.holdout_overlap(_shift_rows(spark, sf), "outer_holdout_id")
    tripled = splits.withColumn("model", F.explode(F.array(*[F.lit(m) for m in "ABC"])))
    return tidy(Su.overlap_totals(tripled, SLICE, DAY))


_SHIFT_FEATURES = ["clicks_last_7_days", "historical_average_clicks", "click_z_score", "longest_previous_inactivity_gap", "current_inactivity_gap"]


def _shift_sql(strict: bool) -> str:
    drop = (
        "AND q.entity NOT IN (SELECT entity FROM p0 t WHERE t.observation_day = h.observation_day AND t.outer_holdout_id = h.outer_holdout_id)"
        if strict
        else ""
    )
    feats = " UNION ALL ".join(f"SELECT observation_day, outer_holdout_id, role, actual_label, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM roles" for f in _SHIFT_FEATURES)
    return f"""{A.SEGMENTED},
h AS (SELECT DISTINCT observation_day, outer_holdout_id FROM p0),
roles AS (SELECT p0.*, 'test' AS role FROM p0 UNION ALL
  SELECT q.* REPLACE (h.outer_holdout_id AS outer_holdout_id), 'train' AS role FROM h JOIN p0 q ON q.observation_day = h.observation_day AND q.outer_holdout_id <> h.outer_holdout_id {drop}),
lf AS ({feats}),
st AS (SELECT observation_day, outer_holdout_id, feature, role, avg(actual_label) AS prev, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS miss, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM lf GROUP BY ALL),
sh AS (SELECT t.observation_day, t.outer_holdout_id, t.feature, r.prev AS training_target_prevalence, t.prev AS test_target_prevalence, t.prev - r.prev AS target_prevalence_difference,
  r.miss AS training_missing_rate, t.miss AS test_missing_rate, r.q[2] AS training_median, t.q[2] AS test_median, r.q[3] - r.q[1] AS training_iqr, t.q[3] - t.q[1] AS test_iqr,
  CASE WHEN r.q[3] - r.q[1] <> 0 THEN (t.q[2] - r.q[2]) / (r.q[3] - r.q[1]) END AS standardized_median_difference, coalesce(r.q[3] - r.q[1] = 0, false) AS zero_training_iqr
  FROM st t JOIN st r USING (observation_day, outer_holdout_id, feature) WHERE t.role = 'test' AND r.role = 'train')"""


_SH_COLS = ["training_target_prevalence", "test_target_prevalence", "target_prevalence_difference", "training_missing_rate", "test_missing_rate",
            "training_median", "test_median", "training_iqr", "test_iqr", "standardized_median_difference"]
_SH_SEL = "SELECT observation_day, outer_holdout_id, feature, " + ", ".join(rd(c, c) for c in _SH_COLS) + ", CAST(zero_training_iqr AS BIGINT) AS zero_training_iqr FROM sh"


def _shift_rows(spark, sf):
    return A.by_segment(spark, sf, A.saved_predictions(spark, sf))


@query("d24_dataset_shift_strict", PRED + _shift_sql(True) + _SH_SEL)
def dataset_shift(spark, sf):
    return tidy(Sh.dataset_shift(_shift_rows(spark, sf), _SHIFT_FEATURES, LABEL, "outer_holdout_id"))


@query("d24_dataset_shift_course_only", PRED + _shift_sql(False) + _SH_SEL)
def dataset_shift_course(spark, sf):
    return tidy(Sh.dataset_shift(_shift_rows(spark, sf), _SHIFT_FEATURES, LABEL, "outer_holdout_id", strict=False))


@query(
    "c19_d25_shift_summary",
    PRED + _shift_sql(False) + ", " + safe_sql(SLICE, "p0")
    + """, per AS (SELECT observation_day, outer_holdout_id, avg(abs(standardized_median_difference)) AS fs, abs(any_value(target_prevalence_difference)) AS ps, count(*) FILTER (WHERE zero_training_iqr) AS z FROM sh GROUP BY ALL)
SELECT observation_day, count(*) AS holdouts, """
    + ", ".join(
        [
            rd("avg(fs)", "mean_absolute_standardized_median_shift"),
            rd("avg(ps)", "mean_absolute_prevalence_difference"),
            "CAST(sum(z) AS BIGINT) AS zero_training_iqr_feature_instances",
            rd("corr(average_precision, fs)", "correlation_pr_auc_with_feature_shift"),
            rd("corr(average_precision, ps)", "correlation_pr_auc_with_prevalence_shift"),
            rd("corr(average_precision, positive_rows)", "correlation_pr_auc_with_positive_count"),
        ]
    )
    + " FROM per JOIN rep USING (observation_day, outer_holdout_id) GROUP BY ALL",
)
def shift_summary(spark, sf):
    rows = _shift_rows(spark, sf)
    shift = Sh.dataset_shift(rows, _SHIFT_FEATURES, LABEL, "outer_holdout_id", strict=False)
    rep = X.classification_report(rows, SLICE, SCORE, LABEL)
    return tidy(Sh.shift_summary(shift, rep, DAY, "outer_holdout_id"))


# ---------------------------------------------------------------- thresholds


def cand_sql(by: list[str], source: str = "pred") -> str:
    k = ", ".join(by)
    return f"""tc AS (SELECT {k}, calibrated_output AS t FROM {source} UNION SELECT {k}, 1.0000000000000002 FROM {source} UNION SELECT {k}, 0.0 FROM {source}),
tk AS (SELECT {', '.join('tc.' + c for c in by)}, tc.t AS threshold, count(*) FILTER (WHERE actual_label = 1 AND calibrated_output >= t) AS tp,
  count(*) FILTER (WHERE actual_label = 0 AND calibrated_output >= t) AS fp, count(*) FILTER (WHERE actual_label = 1 AND calibrated_output < t) AS fn,
  count(*) FILTER (WHERE actual_label = 0 AND calibrated_output < t) AS tn FROM tc JOIN {source} p ON {_keys(by, 'p', 'tc')} GROUP BY ALL),
cands AS (SELECT *, {zero_div('tp', 'tp + fp')} AS precision, {zero_div('tp', 'tp + fn')} AS recall, (tp + fp) / (tp + fp + fn + tn) AS alert_rate FROM tk),
cnd AS (SELECT *, {zero_div('2 * precision * recall', 'precision + recall')} AS f1, 5 * fn + fp AS cost FROM cands)"""


_PT = ", ".join([rd("threshold", "threshold"), rd("precision", "precision"), rd("recall", "recall"), rd("f1", "f1"), rd("alert_rate", "alert_rate")]) + ", CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(tn AS BIGINT) AS true_negatives"


@query("d46_threshold_candidates", PRED + cand_sql(DAY) + f"SELECT observation_day, {_PT} FROM cnd")
def threshold_candidates(spark, sf):
    return tidy(Th.threshold_candidates(A.saved_predictions(spark, sf), DAY, SCORE, LABEL))


def _select_sql(by: list[str]) -> str:
    k = ", ".join(by)

    def pick(name: str, where: str, order: str, fallback: int = 0) -> str:
        return f"SELECT {k}, '{name}' AS threshold_policy, threshold, precision, recall, f1, alert_rate, tp, fp, fn, tn, {fallback} AS fb FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS rn FROM (SELECT *, max(recall) OVER (PARTITION BY {k}) AS best FROM cnd) WHERE {where}) WHERE rn = 1"

    return (
        cand_sql(by)
        + ", sel AS ("
        + " UNION ALL ".join(
            [
                pick("recall_focused", "recall >= 0.8", "threshold DESC, precision DESC"),
                pick("recall_focused", "best < 0.8", "recall DESC, precision DESC, threshold DESC", 1),
                pick("f1_focused", "true", "f1 DESC, recall DESC, threshold DESC"),
                pick("alert_capacity", "alert_rate <= 0.1", "recall DESC, threshold ASC"),
                pick("cost_sensitive", "true", "cost ASC, recall DESC, threshold DESC"),
                f"SELECT {k}, 'fixed', 0.5, precision, recall, f1, alert_rate, tp, fp, fn, tn, 0 FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY threshold) AS rn FROM cnd WHERE threshold >= 0.5) WHERE rn = 1",
            ]
        )
        + ")"
    )


@query("d47_threshold_policies", PRED + _select_sql(SLICE) + f"SELECT observation_day, outer_holdout_id, threshold_policy, {_PT}, CAST(fb AS BIGINT) AS selection_fallback FROM sel")
def threshold_policies(spark, sf):
    return tidy(Th.select_thresholds(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL))


@query(
    "d48_policy_summary",
    PRED + _policy_sql()
    + f""", sp AS (SELECT observation_day, policy, avg(selected_threshold) AS tm, stddev_samp(selected_threshold) AS ts FROM (SELECT DISTINCT observation_day, outer_holdout_id, policy, selected_threshold FROM ld) GROUP BY ALL),
{conf_sql('observation_day, policy', 'ld', 'decision', 'pc')}
SELECT observation_day, policy AS threshold_policy, {rd('tm', 'selected_threshold_mean')}, {rd('ts', 'selected_threshold_standard_deviation')}, n AS rows, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
 {rd('(tp + tn) / n', 'accuracy')}, {rd(zero_div('tp', 'tp + fp'), 'precision')}, {rd(zero_div('tp', 'tp + fn'), 'recall')}, {rd(zero_div('2 * tp', '2 * tp + fp + fn'), 'f1')}, tp + fp AS predicted_positive_rows,
 {rd('(tp + fp) / n', 'alert_rate')}, {rd('5 * fn + fp', 'cost')} FROM pc JOIN sp USING (observation_day, policy)""",
)
def policy_summary(spark, sf):
    long = Th.long_decisions(A.saved_predictions(spark, sf), _POL, [*SLICE, LABEL])
    by = ["observation_day", "threshold_policy"]
    per = long.select(*by, "outer_holdout_id", "selected_threshold").distinct()
    return tidy(Th.policy_summary(per, long, by))


@query(
    "d49_tradeoff_curve",
    PRED + f"""g AS (SELECT observation_day, i * CAST(0.01 AS DOUBLE) AS t FROM (SELECT DISTINCT observation_day FROM pred), range(101) r(i)),
tk AS (SELECT g.observation_day, g.t AS threshold, count(*) FILTER (WHERE actual_label = 1 AND calibrated_output >= t) AS tp, count(*) FILTER (WHERE actual_label = 0 AND calibrated_output >= t) AS fp,
 count(*) FILTER (WHERE actual_label = 1 AND calibrated_output < t) AS fn, count(*) FILTER (WHERE actual_label = 0 AND calibrated_output < t) AS tn FROM g JOIN pred USING (observation_day) GROUP BY ALL),
cands AS (SELECT *, {zero_div('tp', 'tp + fp')} AS precision, {zero_div('tp', 'tp + fn')} AS recall, (tp + fp) / (tp + fp + fn + tn) AS alert_rate FROM tk),
cnd AS (SELECT *, {zero_div('2 * precision * recall', 'precision + recall')} AS f1 FROM cands)
SELECT observation_day, {_PT} FROM cnd""",
)
def tradeoff_curve(spark, sf):
    return tidy(Th.tradeoff_curve(A.saved_predictions(spark, sf), DAY, SCORE, LABEL))


@query(
    "b05_decision_mismatches",
    PRED.rstrip(", ")
    + " UNION ALL ".join(
        f" SELECT '{p}' AS threshold_policy, count(*) AS checked, count(*) FILTER (WHERE CAST(calibrated_output >= {p}_threshold AS INTEGER) <> {p}_prediction) AS mismatches FROM pred"
        for p in _POL
    ),
)
def decision_mismatches(spark, sf):
    return Th.decision_mismatches(A.saved_predictions(spark, sf), _POL)


@query(
    "b11_prediction_violations",
    PRED.rstrip(", ")
    + """ SELECT count(*) AS checked, count(*) FILTER (WHERE actual_label NOT IN (0, 1)) AS invalid_labels, count(*) FILTER (WHERE calibrated_output NOT BETWEEN 0 AND 1) AS invalid_scores,
      CAST(0 AS BIGINT) AS invalid_decisions, count(*) FILTER (WHERE outer_holdout_id <> unit || '_' || period) AS foreign_holdouts FROM pred""",
)
def violations(spark, sf):
    return Th.prediction_violations(A.saved_predictions(spark, sf), A.POLICIES)


# ---------------------------------------------------------------- folds and baselines

_H = "('0x' || substr(md5({x}), 1, 15))"


def _index_sql(name: str, source: str, strata: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY substr(md5('42|' || entity), 1, 3), entity) - 1 AS idx, count(*) OVER (PARTITION BY {strata}) AS n FROM {source})"


_PROF = "prof AS (SELECT outer_holdout_id, entity, max(actual_label) AS stratum FROM pred GROUP BY ALL), "
_COURSE_INDEX = _PROF + _index_sql("ix", "prof", "outer_holdout_id, stratum")
_COURSE = ["outer_holdout_id"]
_COURSES = [f"M{m}_P{p}" for m in range(3) for p in range(2)]


@query(
    "j02_prior_scores",
    PRED
    + "pr AS (SELECT h.outer_holdout_id, avg(q.actual_label) AS prior FROM (SELECT DISTINCT outer_holdout_id FROM pred) h JOIN pred q ON q.outer_holdout_id <> h.outer_holdout_id GROUP BY ALL) SELECT unit, period, entity, observation_day, "
    + rd("prior", "score") + " FROM pred JOIN pr USING (outer_holdout_id)",
)
def prior_scores(spark, sf):
    rows = A.saved_predictions(spark, sf)
    parts = [
        H.prior_scores(*H.leave_one_out(rows, "outer_holdout_id", c, strict=False), LABEL).select(*OBSERVATION_KEYS, "score")
        for c in _COURSES
    ]
    return tidy(reduce(DataFrame.unionByName, parts))


@query(
    "j03_entity_split",
    PRED + _COURSE_INDEX
    + " SELECT unit, period, p.entity, observation_day, CASE WHEN idx < ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS role FROM pred p JOIN ix USING (outer_holdout_id, entity)",
)
def entity_split(spark, sf):
    return tidy(H.entity_split(A.saved_predictions(spark, sf), LABEL, by=_COURSE).select(*OBSERVATION_KEYS, "role"))


@query("j04_fold_assignment", PRED + _COURSE_INDEX + " SELECT outer_holdout_id, entity, idx % 5 + 1 AS fold FROM ix")
def fold_assignment(spark, sf):
    return tidy(H.fold_assignment(A.saved_predictions(spark, sf), LABEL, 5, by=_COURSE))


@query(
    "j04_fold_classes",
    PRED + _COURSE_INDEX
    + """, f AS (SELECT outer_holdout_id, entity, idx % 5 + 1 AS fold FROM ix),
v AS (SELECT outer_holdout_id, fold, count(*) AS validation_rows, CAST(sum(actual_label) AS BIGINT) AS validation_positives, count(DISTINCT entity) AS validation_entities FROM pred JOIN f USING (outer_holdout_id, entity) GROUP BY ALL),
a AS (SELECT outer_holdout_id, count(*) AS n, sum(actual_label) AS pos FROM pred GROUP BY ALL),
w AS (SELECT v.*, CAST(n - validation_rows AS BIGINT) AS training_rows, CAST(pos - validation_positives AS BIGINT) AS training_positives FROM v JOIN a USING (outer_holdout_id))
SELECT *, CAST(validation_positives > 0 AND validation_positives < validation_rows AND training_positives > 0 AND training_positives < training_rows AS BIGINT) AS valid FROM w""",
)
def fold_classes(spark, sf):
    rows = A.saved_predictions(spark, sf)
    return tidy(H.fold_classes(rows, H.fold_assignment(rows, LABEL, 5, by=_COURSE), LABEL, by=_COURSE))


_PATTERN = """pat AS (SELECT entity, string_agg(y, '' ORDER BY d) AS stratum FROM (
  SELECT e.entity, d, coalesce(CAST(max(actual_label) AS VARCHAR), '-') AS y FROM (SELECT DISTINCT entity FROM pred) e CROSS JOIN (VALUES (10), (13), (16), (19)) v(d)
  LEFT JOIN pred p ON p.entity = e.entity AND p.observation_day = d GROUP BY ALL) GROUP BY ALL), """
_PAT_FOLD = _PATTERN + _index_sql("ix", "pat", "stratum") + """,
sz AS (SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pat GROUP BY stratum),
pf AS (SELECT entity, CAST((start + idx) % 4 + 1 AS BIGINT) AS fold FROM ix JOIN sz USING (stratum))
"""


@query("j05_pattern_folds", PRED + _PAT_FOLD + "SELECT * FROM pf")
def pattern_folds(spark, sf):
    return tidy(H.pattern_folds(A.saved_predictions(spark, sf), LABEL, A.OBS, 4))


@query(
    "j05_fold_balance",
    PRED + _PAT_FOLD
    + """, c AS (SELECT observation_day, fold, sum(actual_label) AS c FROM pred JOIN pf USING (entity) GROUP BY ALL),
pd AS (SELECT sum((c - m) * (c - m)) AS d FROM (SELECT *, avg(c) OVER (PARTITION BY observation_day) AS m FROM c)),
sd AS (SELECT sum((c - m) * (c - m)) AS d FROM (SELECT count(*) AS c, avg(count(*)) OVER () AS m FROM pf GROUP BY fold))
SELECT """ + rd("pd.d", "positive_deviation") + ", " + rd("sd.d", "size_deviation") + ", " + rd("pd.d * 1000 + sd.d", "balance_score") + " FROM pd, sd",
)
def fold_balance(spark, sf):
    p = A.saved_predictions(spark, sf)
    return tidy(H.fold_balance(p, H.pattern_folds(p, LABEL, A.OBS, 4), LABEL))


@query(
    "c11_common_cohort",
    PRED + "cc AS (SELECT unit, period, entity FROM pred GROUP BY ALL HAVING count(*) = 4 AND count(DISTINCT observation_day) = 4) SELECT unit, period, entity, observation_day, actual_label FROM pred JOIN cc USING (unit, period, entity)",
)
def common_cohort(spark, sf):
    return tidy(H.common_cohort(A.saved_predictions(spark, sf), A.OBS, ENTITY_KEYS).select(*OBSERVATION_KEYS, LABEL))
