"""Jobs over saved predictions: workload, trajectories, subgroups, monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators import audit as Au
from tidemark.operators import review as R
from tidemark.operators import trajectories as Tr
from tidemark.operators.thresholds import decision_mismatches
from tidemark.schema import ENTITY_KEYS, UNIT_KEYS
from tidemark.session import cut_lineage, written


def workload_comparison(
    events: DataFrame, scenarios: Sequence[R.Scenario], days: Sequence[int], step_days: int = 14
) -> dict[str, DataFrame]:
    """Cases, checkpoint rows and scenario summaries of review scenarios."""
    rows = written(events, "review-events")
    lanes = R.allocate_reviews(rows, scenarios, days, step_days)
    cases = R.review_cases(lanes)
    checkpoints = R.review_checkpoints(lanes, rows, scenarios, days)
    policies = sorted({s.policy for s in scenarios})
    summary = R.loss_against_unlimited(R.scenario_summary(cases, checkpoints, rows, policies))
    return {"cases": cases, "checkpoints": checkpoints, "scenarios": summary}


def subgroup_audit(
    predictions: DataFrame,
    labelled: DataFrame,
    attributes: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    primary: str,
    others: Sequence[str],
    support: Au.Support = Au.GROUP_SUPPORT,
    pair_support: Au.Support = Au.INTERSECTION_SUPPORT,
) -> dict[str, DataFrame]:
    """All subgroup tables of saved held-out predictions."""
    rows = cut_lineage(Au.join_attributes(predictions, labelled, attributes))
    metrics = cut_lineage(Au.group_metrics(rows, attributes, [primary, *others], support))
    gaps = Au.disparities(metrics)
    return {
        "decision_mismatches": decision_mismatches(predictions, [primary, *others]),
        "metrics": metrics,
        "disparities": gaps,
        "course_adjusted": Au.course_adjusted(rows, metrics, attributes, primary, support),
        "intersections": Au.intersection_metrics(rows, pairs, primary, pair_support),
        "missingness": Au.missingness(rows, attributes, primary, support),
        "policy_sensitivity": Au.policy_sensitivity(gaps, primary),
    }


def stability_analysis(
    predictions: DataFrame,
    daily: DataFrame,
    course_lengths: DataFrame,
    days: Sequence[int],
    decision: str,
    start_day: int = 15,
    quiet_days: int = 14,
    tolerance: float = 0.05,
) -> dict[str, DataFrame]:
    """Trajectories, episodes, transitions and strategy tables."""
    table = Tr.trajectory_table(predictions, days, decision, tolerance=tolerance)
    episodes = Tr.inactivity_episodes(daily, predictions.select(*ENTITY_KEYS), course_lengths, start_day, quiet_days)
    full = cut_lineage(Tr.attach_episodes(table, episodes, days))
    pairs = cut_lineage(Tr.adjacent_pairs(predictions, days, decision))
    by_course = Tr.strategy_outcomes(full, days, UNIT_KEYS)
    return {
        "trajectories": full,
        "transitions": Tr.transition_table(pairs, tolerance),
        "agreement": Tr.agreement(pairs),
        "stability": Tr.stability_rates(full, [], len(days)),
        "strategies": Tr.strategy_outcomes(full, days),
        "course_strategies": by_course,
        "course_macro": Tr.course_macro_summary(by_course),
        "courses": Tr.course_summary(full, days),
        "confirmation_delays": Tr.confirmation_delays(full, days),
        "episode_timing": Tr.episode_timing(full, days),
        "episode_summary": Tr.episode_summary(full),
        "disappearances": Tr.disappearances(pairs, daily, quiet_days),
        "sequences": Tr.sequence_histogram(full),
        "first_warnings": Tr.first_warning_histogram(full),
    }


def monitoring_report(
    batch: DataFrame,
    reference: DataFrame,
    features: Sequence[str],
    score: str,
    label: str | None = None,
    aligned: bool = False,
    threshold: float = 0.5,
) -> dict[str, DataFrame]:
    """Feature and score drift of a scored batch; performance once labels exist."""
    from tidemark.operators import drift as Dr

    features_drift = Dr.feature_drift(batch, Dr.feature_profile(reference, features), features)
    out = {
        "features": features_drift,
        "scores": Dr.score_drift(batch, reference, score, threshold),
        "alert_counts": Dr.alert_counts(features_drift),
    }
    if label is not None:
        out["performance"] = Dr.delayed_performance(batch, score, label, threshold, aligned)
    return out
