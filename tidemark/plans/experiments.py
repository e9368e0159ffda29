"""Experiments: a driver loop of Spark ML fits around the metric operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import decision, fixed_rule, inverse_logit
from tidemark.operators import calibration as Ca
from tidemark.operators import explain as Ex
from tidemark.operators import fits as Fi
from tidemark.operators import holdout as H
from tidemark.operators import metrics as X
from tidemark.operators import models as Mo
from tidemark.operators import summaries as Su
from tidemark.operators import thresholds as Th
from tidemark.operators.trajectories import representative_rows, start_end_patterns
from tidemark.schema import CHANGE_FEATURES, FEATURE_GROUPS, MODEL_FEATURES, OBSERVATION_KEYS
from tidemark.session import cut_lineage, written

LABEL = "actual_label"


def _labelled(rows: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Keys, 0/1 label, features and holdout id; unit and period form the id by default."""
    if "outer_holdout_id" not in rows.columns:
        rows = rows.withColumn("outer_holdout_id", F.concat_ws("_", "unit", "period"))
    return cut_lineage(
        rows.select(*OBSERVATION_KEYS, "outer_holdout_id", F.col(label).cast("int").alias(LABEL), *features)
    )


def baseline_experiment(rows: DataFrame, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Dummy, fixed rule and logistic model on one entity-level split."""
    data = cut_lineage(H.entity_split(_labelled(rows, label, MODEL_FEATURES), LABEL, test_share, seed))
    train, test = data.where("role = 'train'"), data.where("role = 'test'")
    model = Mo.fit_base_model(train, MODEL_FEATURES, LABEL)
    rule = fixed_rule(
        F.col("current_inactivity_gap"),
        F.col("click_percentage_change_from_personal_average"),
        F.col("active_days_last_7_days"),
    )
    parts = [
        H.prior_scores(train, test, LABEL).select(LABEL, "score").withColumn("model", F.lit("dummy")),
        test.select(LABEL, rule.cast("double").alias("score")).withColumn("model", F.lit("rule_based")),
        Mo.apply_base_model(model, test, "score").select(LABEL, "score").withColumn("model", F.lit("logistic_regression")),
    ]
    report = X.zero_rates(X.ranking_metrics(Mo.union_all(parts), ["model"], "score", LABEL))
    rank_free = F.col("model") == "rule_based"
    return report.withColumns(
        {c: F.when(~rank_free, F.col(c)) for c in ("roc_auc", "average_precision", "brier_score", "log_loss")}
    )


def ablation_experiment(
    rows: DataFrame, label: str, folds: int = 5, seed: int = 42, groups: dict[str, list[str]] = FEATURE_GROUPS
) -> dict[str, DataFrame]:
    """Out-of-fold scores of feature groups on the same entity folds."""
    data = _labelled(rows, label, MODEL_FEATURES)
    assignment, count, _ = H.grouped_folds(data, LABEL, folds, seed)
    assignment = cut_lineage(assignment)

    scored = Fi.fold_scores(data, assignment, count, groups, LABEL, [*OBSERVATION_KEYS, LABEL])
    oof = cut_lineage(scored.select(*OBSERVATION_KEYS, LABEL, "fold", "score", "model"))
    per_fold = X.zero_rates(X.ranking_metrics(oof, ["model", "fold"], "score", LABEL))
    metrics = ["average_precision", "recall", "precision", "f1", "brier_score"]
    names = list(groups)
    pairs = {f"{b}_minus_{a}": (b, a) for i, a in enumerate(names) for b in names[i + 1 :]}
    paired = Su.paired_differences(per_fold, [], "fold", "model", pairs, metrics)
    return {
        "oof": oof,
        "folds": per_fold,
        "summary": Su.macro_summary(per_fold, ["model"], metrics),
        "pooled": X.zero_rates(X.ranking_metrics(oof, ["model"], "score", LABEL)),
        "paired": Su.paired_summary(paired, []),
    }


def early_warning_experiment(
    rows: DataFrame, label: str, days: Sequence[int], folds: int = 5, seed: int = 42
) -> dict[str, DataFrame]:
    """Day-specific models on common folds, reduced only where a day needs it."""
    data = _labelled(rows, label, CHANGE_FEATURES)
    common, count, _ = H.grouped_folds(data, LABEL, folds, seed)
    common = cut_lineage(common)

    def run(day: int) -> DataFrame:
        day_rows = data.where(F.col("observation_day") == day)
        found = H.fold_classes(day_rows, common, LABEL).select("valid").collect()
        valid = len(found) == count and all(r.valid for r in found)
        assignment, k = (common, count) if valid else H.grouped_folds(day_rows, LABEL, folds, seed)[:2]
        scored = Fi.fold_scores(day_rows, assignment, k, {"change": CHANGE_FEATURES}, LABEL, [*OBSERVATION_KEYS, LABEL])
        return scored.select(*OBSERVATION_KEYS, LABEL, "fold", "score", F.lit(valid).alias("common_folds"))

    oof = cut_lineage(Mo.union_all(Mo.each(list(days), run, 2))).withColumn("prediction", decision(F.col("score"), 0.5))
    per_fold = X.zero_rates(X.ranking_metrics(oof, ["observation_day", "fold"], "score", LABEL))
    return {
        "oof": oof,
        "folds": per_fold,
        "summary": Su.macro_summary(per_fold, ["observation_day"], ["average_precision", "roc_auc", "recall", "precision", "f1", "brier_score"]),
        "pooled": X.classification_report(oof, ["observation_day"], "score", LABEL),
        "patterns": start_end_patterns(oof, days, "prediction"),
    }


def common_cohort_experiment(
    rows: DataFrame, label: str, days: Sequence[int], folds: int = 4, samples: int = 1000, seed: int = 42
) -> dict[str, DataFrame]:
    """Day-specific models on one cohort with shared folds, plus bootstrap intervals."""
    from tidemark.operators.resampling import day_metric_intervals
    from tidemark.schema import ENTITY_KEYS

    data = _labelled(rows, label, CHANGE_FEATURES)
    cohort = cut_lineage(H.common_cohort(data, days, ENTITY_KEYS))
    assignment = cut_lineage(H.pattern_folds(cohort, LABEL, days, folds, seed))

    def run(day: int) -> DataFrame:
        scored = Fi.fold_scores(
            cohort.where(F.col("observation_day") == day), assignment, folds, {"change": CHANGE_FEATURES}, LABEL, [*OBSERVATION_KEYS, LABEL]
        )
        return scored.select(*OBSERVATION_KEYS, LABEL, "fold", "score")

    oof = cut_lineage(Mo.union_all(Mo.each(list(days), run, 2)))
    pooled = X.classification_report(oof, ["observation_day"], "score", LABEL)
    names = [str(d) for d in days]
    steps = {f"day_{b}_minus_day_{a}": (b, a) for a, b in [*zip(names, names[1:]), (names[0], names[-1])]}
    by_day = pooled.withColumn("day", F.col("observation_day").cast("string")).withColumn("all", F.lit("all"))
    return {
        "oof": oof,
        "pooled": pooled,
        "intervals": day_metric_intervals(oof, samples, seed, "score", LABEL),
        "day_differences": Su.paired_differences(
            by_day, [], "all", "day", steps, ["average_precision", "pr_auc_lift", "recall", "precision", "f1", "brier_score"]
        ).drop("all"),
    }


def cross_course_experiment(
    rows: DataFrame,
    label: str,
    days: Sequence[int],
    groups: dict[str, list[str]] = FEATURE_GROUPS,
    designs: Sequence[str] = ("grouped", "presentation", "module"),
    strict: Sequence[bool] = (False, True),
    folds: int = 5,
    seed: int = 42,
    parallel: int = 4,
) -> dict[str, DataFrame]:
    """Grouped folds and held-out courses or units for each feature group."""
    data = _labelled(rows, label, MODEL_FEATURES)
    jobs = []
    for day in days:
        day_rows = data.where(F.col("observation_day") == day)
        if "grouped" in designs:
            assignment, count, _ = H.grouped_folds(day_rows, LABEL, folds, seed)
            held = cut_lineage(day_rows.join(assignment, "entity"))
            for f in range(1, count + 1):
                jobs.append((day, "grouped", "student-disjoint", f"fold_{f}", held.where(F.col("fold") != f).drop("fold"), held.where(F.col("fold") == f).drop("fold")))
        for design, column in (("presentation", "outer_holdout_id"), ("module", "unit")):
            if design not in designs:
                continue
            for (value,) in sorted(day_rows.select(column).distinct().collect()):
                for flag in strict:
                    train, test = H.leave_one_out(day_rows, column, value, flag)
                    jobs.append((day, design, "student-disjoint" if flag else "course-only", value, train, test))

    def run(job) -> DataFrame:
        day, design, policy, holdout, train, test = job
        train = cut_lineage(train)
        scored = []
        for name, features in groups.items():
            model = Mo.fit_base_model(train, features, LABEL)
            out = Mo.apply_base_model(model, test, "model_output").select(
                *OBSERVATION_KEYS, LABEL, "model_output",
                F.lit(design).alias("evaluation_design"), F.lit(policy).alias("overlap_policy"),
                F.lit(holdout).alias("fold_or_holdout_id"), F.lit(name).alias("model"),
            )
            scored.append(out)
        return Mo.union_all(scored)

    predictions = cut_lineage(Mo.union_all(Mo.each(jobs, run, parallel)))
    context = ["evaluation_design", "overlap_policy", "observation_day"]
    holdouts = X.classification_report(predictions, [*context, "model", "fold_or_holdout_id"], "model_output", LABEL)
    holdouts = cut_lineage(holdouts)
    pairs = {}
    names = list(groups)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs[f"{b}_minus_{a}"] = (b, a)
    metrics = ["average_precision", "pr_auc_lift", "recall", "precision", "f1", "brier_score"]
    out = {
        "predictions": predictions,
        "holdouts": holdouts,
        "macro": Su.macro_summary(holdouts, [*context, "model"], ["accuracy", "balanced_accuracy", "specificity", "roc_auc", *metrics]),
        "pooled": X.classification_report(predictions, [*context, "model"], "model_output", LABEL),
        "worst": Su.worst_slices(
            holdouts.where("evaluation_design <> 'grouped'"), [*context, "model"], "fold_or_holdout_id",
            {
                "lowest_pr_auc": ("average_precision", "min"),
                "lowest_recall": ("recall", "min"),
                "lowest_precision": ("precision", "min"),
                "highest_false_negative_rate": ("false_negative_rate", "max"),
                "highest_false_positive_rate": ("false_positive_rate", "max"),
            },
        ),
    }
    if pairs:
        paired = Su.paired_differences(holdouts, context, "fold_or_holdout_id", "model", pairs, metrics)
        out["paired"] = Su.paired_summary(paired, context)
    return out


def calibration_experiment(
    rows: DataFrame,
    label: str,
    days: Sequence[int],
    methods: Sequence[str] = Mo.METHODS,
    inner_folds: int = 5,
    seed: int = 42,
    features: Sequence[str] = tuple(CHANGE_FEATURES),
    parallel: int = 4,
) -> dict[str, DataFrame]:
    """Nested calibration: thresholds and calibrators see inner OOF scores only."""
    data = _labelled(rows, label, features)
    jobs = [
        (r.observation_day, r.outer_holdout_id)
        for r in data.where(F.col("observation_day").isin(list(days))).select("observation_day", "outer_holdout_id").distinct().collect()
    ]

    keep = [*OBSERVATION_KEYS, LABEL, "base_model_score"]

    def run(day: int) -> tuple[DataFrame, DataFrame]:
        # the final and the inner models of all holdouts of a day are fitted together
        values = sorted(holdout for d, holdout in jobs if d == day)
        day_rows = data.where(F.col("observation_day") == day)
        folds, counts = H.strict_training_folds(day_rows, "outer_holdout_id", values, LABEL, inner_folds, seed)
        assigned = written(day_rows.join(folds, "entity", "left"), "holdout-folds")
        fold = [F.coalesce(F.col("folds")[s], F.lit(0)) for s in range(len(values))]
        trains = [(fold[s] > 0) & (fold[s] != j) for s, count in enumerate(counts) for j in range(count + 1)]
        member = F.array(*[t.cast("tinyint") for t in trains])
        fits = Fi.fit_models(assigned.withColumn(Fi.MEMBER, member), [list(features)] * len(trains), LABEL)
        scored = written(fits.logits(assigned, [*OBSERVATION_KEYS, LABEL, "outer_holdout_id", "folds"]), "holdout-logits")
        final = [sum(counts[:s]) + s + 1 for s in range(len(values))]
        ids, finals = F.array(*[F.lit(v) for v in values]), F.array(*[F.lit(i) for i in final])
        score = inverse_logit(F.col("logit")).alias("base_model_score")
        tested = scored.withColumn(
            "logit", F.element_at("logits", F.element_at(finals, F.array_position(ids, F.col("outer_holdout_id")).cast("int")))
        )
        inner = (
            scored.drop("outer_holdout_id")
            .select("*", F.posexplode("folds").alias("s", "fold"))
            .where("fold > 0")
            .withColumns({"logit": F.element_at("logits", finals[F.col("s")] + F.col("fold")), "outer_holdout_id": ids[F.col("s")]})
        )
        pick = lambda df: df.withColumn("base_model_score", score).select(*keep, "outer_holdout_id")
        return pick(inner), pick(tested)

    done = Mo.each(sorted({day for day, _ in jobs}), run, parallel)
    holdout_slice = ["observation_day", "outer_holdout_id"]
    scored = [cut_lineage(Mo.union_all(part)) for part in zip(*done)]
    # the mappings of all holdouts at once, from inner scores only
    lines = cut_lineage(Ca.sigmoid_mappings(scored[0], holdout_slice, "base_model_score", LABEL))
    blocks = cut_lineage(Ca.isotonic_blocks(scored[0], holdout_slice, "base_model_score", LABEL))

    def calibrated(df: DataFrame, method: str) -> DataFrame:
        if method == "sigmoid":
            df = Ca.apply_sigmoid(df, holdout_slice, "base_model_score", lines)
        elif method == "isotonic":
            df = Ca.apply_isotonic(df, holdout_slice, "base_model_score", blocks)
        elif method == "uncalibrated":
            df = df.withColumn("calibrated_output", F.col("base_model_score"))
        else:
            raise ValueError(f"unknown calibration method {method}")
        return df.withColumn("calibration_method", F.lit(method))

    slices = [*holdout_slice, "calibration_method"]
    inner, outer = (cut_lineage(Mo.union_all([calibrated(df, m) for m in methods])) for df in scored)
    thresholds = cut_lineage(Th.select_thresholds(inner, slices, "calibrated_output", LABEL))
    decided = outer.join(
        thresholds.select(*slices, "threshold_policy", F.col("threshold").alias("selected_threshold")), slices
    ).withColumn("decision", decision(F.col("calibrated_output"), F.col("selected_threshold")))
    policy_slice = ["observation_day", "calibration_method", "threshold_policy"]
    holdouts = X.calibration_report(outer, slices, "calibrated_output", LABEL)
    holdouts = cut_lineage(holdouts.join(Ca.calibration_lines(outer, slices, "calibrated_output", LABEL), slices))
    return {
        "predictions": outer,
        "thresholds": thresholds,
        "decisions": decided,
        "warnings": Ca.calibration_messages(scored[0], holdout_slice, LABEL),
        "holdouts": holdouts,
        "curves": X.calibration_bins(outer, ["observation_day", "calibration_method"], "calibrated_output", LABEL),
        "pooled": X.calibration_report(outer, ["observation_day", "calibration_method"], "calibrated_output", LABEL),
        "policies": Th.policy_summary(
            thresholds.withColumnRenamed("threshold", "selected_threshold"), decided, policy_slice
        ),
        "paired": Su.paired_summary(
            Su.paired_differences(
                holdouts, ["observation_day"], "outer_holdout_id", "calibration_method",
                {f"{b}_minus_{a}": (b, a) for a, b in (("uncalibrated", "sigmoid"), ("uncalibrated", "isotonic"), ("sigmoid", "isotonic")) if a in methods and b in methods},
                ["brier_score", "log_loss", "expected_calibration_error", "average_precision"],
            ),
            ["observation_day"],
            lower_is_better=True,
        ) if len(methods) > 1 else None,
    }


def explainability_experiment(
    rows: DataFrame, label: str, days: Sequence[int], folds: int = 4, repeats: int = 30, seed: int = 42
) -> dict[str, DataFrame]:
    """Coefficients, permutation importance and representative explanations."""
    data = _labelled(rows, label, CHANGE_FEATURES)

    def run(day: int) -> tuple:
        day_rows = data.where(F.col("observation_day") == day)
        assignment, count, _ = H.grouped_folds(day_rows, LABEL, folds, seed)
        assigned = cut_lineage(day_rows.join(assignment, "entity"))
        oof, models = Mo.out_of_fold_scores(day_rows, assignment, count, CHANGE_FEATURES, LABEL, "model_output")
        parts = [
            Ex.logit_parts(model, assigned.where(F.col("fold") == fold), [*OBSERVATION_KEYS, "fold"], LABEL)
            for fold, model in enumerate(models, 1)
        ]
        return oof, [({"observation_day": day, "fold": fold}, model) for fold, model in enumerate(models, 1)], Mo.union_all(parts)

    done = Mo.each(list(days), run, 2)
    scored = [oof for oof, _, _ in done]
    fitted = [pair for _, pairs, _ in done for pair in pairs]
    # the shuffles of all days and folds take two passes together
    parts = written(Mo.union_all([p for _, _, p in done]), "logit-parts")
    importances = cut_lineage(
        Ex.permutation_from_parts(parts, CHANGE_FEATURES, OBSERVATION_KEYS, LABEL, repeats, seed, by=["observation_day", "fold"])
    )
    coefficients = Mo.coefficient_rows(fitted)
    summary = Ex.summarize_coefficients(coefficients)
    predictions = cut_lineage(Mo.union_all(scored)).withColumn("prediction", decision(F.col("model_output"), 0.5))
    chosen = representative_rows(
        predictions, ["observation_day", LABEL, "prediction"], "model_output", ["entity", "unit", "period"]
    )
    explained = [
        Ex.contributions(m, chosen.where((F.col("observation_day") == t["observation_day"]) & (F.col("fold") == t["fold"])).drop("model_output"), [*OBSERVATION_KEYS, LABEL, "prediction", "fold"])
        for t, m in fitted
    ]
    return {
        "coefficients": coefficients,
        "coefficient_summary": summary,
        "top_coefficients": Ex.top_coefficients(summary),
        "comparison": Ex.compare_rankings(summary, days[0], days[-1]),
        "importance_summary": Ex.summarize_importance(importances),
        "explanations": Mo.union_all(explained),
    }
