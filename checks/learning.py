"""Spark ML experiments over the whole modeling table (rows-only checks), and their arithmetic with fixed coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.adapter import MODELING
from checks.metrics import PRED, _select_sql
from checks.registry import ORACLES, query, tidy
from tidemark.operators import models as Mo
from tidemark.plans import experiments as E
from tidemark.schema import CHANGE_FEATURES, FEATURE_GROUPS, OBSERVATION_KEYS, TARGET

DAYS = (13,)


def _rows(spark, sf):
    return A._saved(spark, sf, "modeling", A.modeling)


def _segments(spark, sf):
    return A.by_segment(spark, sf, _rows(spark, sf))


@query("j01_m08_baseline_experiment")
def baseline(spark, sf):
    return tidy(E.baseline_experiment(_rows(spark, sf), TARGET))


@query("j06_j19_reference_model_scores")
def reference(spark, sf):
    rows = _rows(spark, sf).withColumn("y", F.col(TARGET).cast("int"))
    _, _, oof = Mo.fit_reference(rows, "y", folds=3)
    return tidy(oof.select(*OBSERVATION_KEYS, "fold", "y", "calibrated_output"))


@query("j07_b10_batch_scores")
def batch_scores(spark, sf):
    """Fit, save, reload and score checked records of the whole feature table."""
    from tidemark.session import scratch_folder

    rows = _rows(spark, sf).withColumn("y", F.col(TARGET).cast("int"))
    model = Mo.fit_base_model(rows, CHANGE_FEATURES, "y")
    folder = scratch_folder(spark, "reference")
    scored = Mo.apply_base_model(model, rows, "p", "raw")
    Mo.save_reference(model, Mo.fit_calibrator("sigmoid_raw", scored, "raw", "y"), folder, "1.0.0")
    records = A.features(spark, sf).select(
        *CHANGE_FEATURES, F.concat_ws("_", "unit", "period", "entity", "day").alias("record_reference")
    )
    good, _ = Mo.score_records(records, folder)
    return tidy(good)


@query("j08_j09_j10_calibrators")
def calibrators(spark, sf):
    p = A.saved_predictions(spark, sf)
    score, label = "calibrated_output", "actual_label"
    parts = [
        Mo.fit_calibrator(m, p, score, label).apply(p, score, "output").select(
            *OBSERVATION_KEYS, F.lit(m).alias("calibration_method"), "output"
        )
        for m in Mo.METHODS
    ]
    line = Mo.calibration_line(p, score, label)
    return tidy(Mo.union_all(parts).withColumns({"line_intercept": F.lit(line[0]), "line_slope": F.lit(line[1])}))


@query("j11_ablation_experiment")
def ablation(spark, sf):
    return tidy(E.ablation_experiment(_rows(spark, sf), TARGET, folds=3)["summary"])


@query("j12_early_warning_experiment")
def early_warning(spark, sf):
    return tidy(E.early_warning_experiment(_rows(spark, sf), TARGET, A.OBS, folds=3)["pooled"])


@query("j13_common_cohort_experiment")
def common_cohort(spark, sf):
    out = E.common_cohort_experiment(_rows(spark, sf), TARGET, A.OBS)
    return tidy(out["day_differences"])


@query("j14_cross_course_experiment")
def cross_course(spark, sf):
    groups = {k: FEATURE_GROUPS[k] for k in ("absolute", "personal_change")}
    out = E.cross_course_experiment(
        _segments(spark, sf), TARGET, DAYS, groups, designs=("presentation",), strict=(True,)
    )
    return tidy(out["macro"])


@query("j15_calibration_experiment")
def calibration(spark, sf):
    out = E.calibration_experiment(_segments(spark, sf), TARGET, DAYS, inner_folds=2)
    return tidy(out["policies"])


@query("j16_j17_d52_feature_importance")
def importance(spark, sf):
    out = E.explainability_experiment(_rows(spark, sf), TARGET, A.OBS, folds=4, repeats=30)
    a = out["coefficient_summary"].select("observation_day", "feature", F.lit("coefficient").alias("kind"), F.col("mean_standardized_coefficient").alias("value"))
    b = out["importance_summary"].select("observation_day", "feature", F.lit("permutation").alias("kind"), F.col("mean_importance").alias("value"))
    return tidy(a.unionByName(b))


@query("j18_f04_contributions")
def contribution_rows(spark, sf):
    from tidemark.operators.explain import contributions

    rows = _rows(spark, sf).withColumn("y", F.col(TARGET).cast("int"))
    model = Mo.fit_base_model(rows, CHANGE_FEATURES, "y")
    out = contributions(model, rows, OBSERVATION_KEYS)
    return tidy(
        out.select(*OBSERVATION_KEYS, "model_output", "contribution_sum_verified", F.col("top_increasing.feature").alias("increasing"), F.col("top_decreasing.feature").alias("decreasing"))
    )


# ---------------------------------------------------------------- shuffled parts of a fixed linear score

_PARTS = {
    "current_inactivity_gap": "0.25 * coalesce(current_inactivity_gap, 12)",
    "active_days_last_7_days": "-0.5 * active_days_last_7_days",
    "clicks_last_7_days": "-least(clicks_last_7_days, 1024) / 256",
}
_REPEATS = 30
_KEYS = ", ".join(OBSERVATION_KEYS)
_MD = " || '|' || ".join(["'42'", *[f"CAST({k} AS VARCHAR)" for k in OBSERVATION_KEYS]])
_SHUFFLED = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, r, a.y, a.raw - a.p{k} + b.p{k} AS raw FROM bl a JOIN turn t ON t.feature = '{f}' AND t.block = a.block
  JOIN bl b ON b.block = a.block AND b.j = (a.j + t.c) % a.m"""
    for k, f in enumerate(_PARTS)
)
_IMPORTANCE = "WITH " + MODELING + f""", pt AS (SELECT {_KEYS}, CAST(future_inactivity AS INTEGER) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS p{k}' for k, e in enumerate(_PARTS.values()))} FROM modeling),
ix AS (SELECT *, p0 + p1 + p2 - 0.5 AS raw, row_number() OVER (ORDER BY substr(md5({_MD}), 1, 3), {_KEYS}) - 1 AS idx, count(*) OVER () AS n FROM pt),
bk AS (SELECT *, idx % CAST(ceil(n / 1024) AS BIGINT) AS block FROM ix),
bl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY idx) - 1 AS j, count(*) OVER (PARTITION BY block) AS m FROM bk),
turn AS (SELECT feature, r, block, CASE WHEN m < 2 THEN 0 ELSE 1 + CAST(('0x' || substr(md5('42|' || feature || '|' || r || '|' || block), 1, 8)) AS BIGINT) % (m - 1) END AS c
  FROM (SELECT DISTINCT block, m FROM bl), (SELECT unnest([{', '.join(f"'{f}'" for f in _PARTS)}]) AS feature), range({_REPEATS}) g(r)),
sh AS ({_SHUFFLED} UNION ALL SELECT 'none', 0, y, raw FROM bl),
sc AS (SELECT feature, r, raw, sum(y) AS p, count(*) AS c FROM sh GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(c) OVER w AS cc FROM sc WINDOW w AS (PARTITION BY feature, r ORDER BY raw DESC)),
ap AS (SELECT feature, r, sum(p * cp / cc) / sum(p) AS ap FROM cu GROUP BY ALL)
SELECT feature, round(round(avg(d), 10), 6) + 0.0 AS importance_mean, round(round(stddev_pop(d), 10), 6) + 0.0 AS importance_standard_deviation, count(*) AS repeats
FROM (SELECT feature, (SELECT ap FROM ap WHERE feature = 'none') - ap AS d FROM ap WHERE feature <> 'none') GROUP BY feature"""


@query("j17_permutation_of_fixed_parts", _IMPORTANCE)
def permutation_of_fixed_parts(spark, sf):
    """Parts are exact binary fractions, so equal logits are equal in both engines."""
    from tidemark.operators.explain import permutation_from_parts

    parts = [F.expr(e).cast("double") for e in _PARTS.values()]
    rows = _rows(spark, sf).select(*OBSERVATION_KEYS, F.col(TARGET).cast("int").alias("y"), F.array(*parts).alias("parts"))
    rows = rows.withColumn("raw", F.col("parts")[0] + F.col("parts")[1] + F.col("parts")[2] - 0.5)
    return tidy(permutation_from_parts(rows, list(_PARTS), OBSERVATION_KEYS, "y", _REPEATS))


# ---------------------------------------------------------------- a saved model with its profile and policies


def _saved_reference(spark, sf):
    from checks.resampling import _DF
    from tidemark.session import scratch_folder

    train = A.saved_predictions(spark, sf).where("observation_day = 10")
    folder = scratch_folder(spark, "reference")
    model = Mo.fit_base_model(train, _DF, "actual_label")
    Mo.save_reference(model, Mo.Calibrator("sigmoid_raw", 1.0, 0.0), folder, "1.0.0", train)
    return folder


@query("j19_m12_saved_profile_drift", ORACLES["d43_feature_drift"])
def saved_profile_drift(spark, sf):
    """The profile saved with the model of day 10, read back and held against day 19."""
    return tidy(Mo.reference_drift(A.saved_predictions(spark, sf).where("observation_day = 19"), _saved_reference(spark, sf)))


@query(
    "j19_d47_saved_policies",
    PRED
    + "p10 AS (SELECT * FROM pred WHERE observation_day = 10), "
    + _select_sql(["observation_day"]).replace("FROM pred", "FROM p10")
    + """ SELECT s.threshold_policy, round(any_value(s.threshold), 6) + 0.0 AS selected_threshold, count(*) AS rows, count(*) FILTER (WHERE p.calibrated_output >= s.threshold) AS alerts,
 count(*) FILTER (WHERE p.calibrated_output >= s.threshold AND p.actual_label = 1) AS true_alerts FROM sel s, pred p WHERE p.observation_day = 19 GROUP BY s.threshold_policy""",
)
def saved_policies(spark, sf):
    """Policies saved with the model of day 10, applied to the scores of day 19."""
    rows = A.saved_predictions(spark, sf).where("observation_day = 19").select("calibrated_output", "actual_label")
    decided = Mo.apply_policies(rows, _saved_reference(spark, sf), "calibrated_output")
    hit = F.col("decision") == 1
    return tidy(
        decided.groupBy("threshold_policy").agg(
            F.first("selected_threshold").alias("selected_threshold"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(hit).alias("alerts"),
            F.count_if(hit & (F.col("actual_label") == 1)).alias("true_alerts"),
        )
    )
