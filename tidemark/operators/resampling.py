"""Bootstrap intervals that every SQL engine reproduces.

Units weigh in by independent Poisson(1) weights (see ``bootstrap``), which stand
in for draws of n of n units: only the number of draws varies, and all measures
here are rates or counts per sample.  Statistics are summed per unit first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import dense_index
from tidemark.functions.scalars import hash_int, ratio
from tidemark.operators.bootstrap import ranking_samples, weighted_sums
from tidemark.operators.draws import draw
from tidemark.operators.trajectories import (
    CONFIRMING,
    STRATEGIES,
    first_strategy_day,
    strategy_state,
)
from tidemark.schema import ENTITY_KEYS
from tidemark.session import cut_lineage


def _draws(indexed: DataFrame, by: Sequence[str], samples: int, seed: int) -> DataFrame:
    """One row per sample and draw: ``by``, ``sample`` and the drawn ``idx``."""
    drawn = F.pmod(
        hash_int(F.lit(seed), *[F.col(c) for c in by], F.col("sample"), F.col("idx")), F.col("group_size")
    )
    return (
        indexed.select(*by, "idx", "group_size")
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .select(*by, "sample", drawn.alias("idx"))
    )


def _join_units(draws: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides are shuffled: tables of units grow with the input, and a broadcast would pass them through the driver."""
    return draws.join(units.hint("merge"), keys)


def resampled_weights(units: DataFrame, keys: Sequence[str], by: Sequence[str], samples: int, seed: int = 42) -> DataFrame:
    """Multiplicity ``w`` of each drawn unit per sample (undrawn units are absent)."""
    by = list(by)
    indexed = cut_lineage(dense_index(units.select(*by, *keys), keys, by, seed))
    counted = _draws(indexed, by, samples, seed).groupBy(*by, "sample", "idx").agg(
        F.count(F.lit(1)).alias("w")
    )
    return _join_units(counted, indexed.select(*by, "idx", *keys), [*by, "idx"]).select(
        *by, "sample", *keys, "w"
    )


def intervals(values: DataFrame, by: Sequence[str], samples: int) -> DataFrame:
    """95 % percentile interval of ``value``; a slice holds at most ``samples`` values."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(q.alias("q"), F.count("value").alias("valid_samples")).select(
        *by,
        F.col("q")[0].alias("lower_95"),
        F.col("q")[1].alias("upper_95"),
        "valid_samples",
        (F.lit(samples) - F.col("valid_samples")).alias("skipped_samples"),
    )


def _long(df: DataFrame, keep: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()]
    )
    return df.select(*keep, F.explode(entries).alias("m")).select(*keep, "m.*")


def day_metric_intervals(
    predictions: DataFrame,
    samples: int = 1000,
    seed: int = 42,
    score: str = "calibrated_output",
    label: str = "actual_label",
    threshold: float = 0.5,
    key: Sequence[str] = ("entity",),
) -> DataFrame:
    """Intervals of ranking and threshold metrics per day, resampling entities.

    Samples whose day holds one class only are skipped and counted.
    """
    report = ranking_samples(predictions, key, ["observation_day"], score, label, threshold, samples, seed)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    values = {
        "average_precision": F.col("average_precision"),
        "roc_auc": F.col("roc_auc"),
        "recall": zero(ratio(tp, tp + fn)),
        "precision": zero(ratio(tp, tp + fp)),
        "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)),
    }
    both = F.col("roc_auc").isNotNull()
    metrics = {m: F.when(both, v) for m, v in values.items()}
    return intervals(_long(report, ["observation_day"], metrics), ["observation_day", "metric"], samples)


_GROUP_SUMS = ["n", "pos", "warned", "tp", "fp", "fn", "tn", "square"]


def group_intervals(
    rows: DataFrame,
    metrics: DataFrame,
    attributes: Sequence[str],
    policy: str,
    samples: int = 1000,
    seed: int = 42,
    score: str = "calibrated_output",
    label: str = "actual_label",
) -> DataFrame:
    """Intervals of supported groups and of their gap to the reference group."""
    from tidemark.operators.audit import _by_attribute, reference_groups

    slices = ["observation_day", "attribute", "group"]
    wanted = metrics.where((F.col("threshold_policy") == policy) & F.col("supported"))
    y, d, s = F.col(label).cast("long"), F.col(f"{policy}_prediction").cast("long"), F.col(score)
    stats = (
        _by_attribute(rows, attributes)
        .groupBy(*slices, "entity")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).alias("pos"),
            F.sum(d).alias("warned"),
            F.sum(y * d).alias("tp"),
            F.sum((1 - y) * d).alias("fp"),
            F.sum(y * (1 - d)).alias("fn"),
            F.sum((1 - y) * (1 - d)).alias("tn"),
            F.sum(F.pow(s - y, F.lit(2.0))).alias("square"),
        )
        .join(wanted.select(*slices), slices, "left_semi")
    )
    sums = weighted_sums(stats, ["entity"], slices, _GROUP_SUMS, samples, seed)
    values = {
        "outcome_prevalence": ratio(F.col("pos"), F.col("n")),
        "warning_rate": ratio(F.col("warned"), F.col("n")),
        "recall": ratio(F.col("tp"), F.col("pos")),
        "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "brier_score": ratio(F.col("square"), F.col("n")),
    }
    shown = _long(wanted, slices, {m: F.col(m) for m in values}).where("value IS NOT NULL").select(*slices, "metric")
    long = cut_lineage(
        _long(sums, [*slices, "sample"], values).join(shown, [*slices, "metric"], "left_semi")
    )
    own = intervals(long, [*slices, "metric"], samples).withColumn("interval_type", F.lit("group"))
    refs = reference_groups(wanted).select("observation_day", "attribute", "reference_group")
    base = (
        long.join(refs, ["observation_day", "attribute"])
        .where(F.col("group") == F.col("reference_group"))
        .select("observation_day", "attribute", "reference_group", "metric", "sample", F.col("value").alias("base"))
    )
    gaps = (
        long.where(F.col("metric").isin("recall", "false_positive_rate", "warning_rate", "brier_score"))
        .join(base, ["observation_day", "attribute", "metric", "sample"])
        .where(F.col("group") != F.col("reference_group"))
        .withColumn("value", F.col("value") - F.col("base"))
    )
    against = intervals(gaps, [*slices, "reference_group", "metric"], samples).withColumn(
        "interval_type", F.lit("group_minus_reference")
    )
    return own.unionByName(against, allowMissingColumns=True)


def _trajectory_sums(trajectories: DataFrame, days: Sequence[int]) -> tuple[DataFrame, list[str], list[tuple[str, int]]]:
    """Per-trajectory 0/1 statistics for stability and strategy metrics."""
    bits, last = F.col("warning_sequence"), len(days) - 1
    columns = {
        "n": F.lit(1),
        "warned": (F.col("warning_count") > 0).cast("int"),
        "persisted": F.col("persistent_warning").cast("int"),
        "reversed": (F.col("warning_reversals") > 0).cast("int"),
        "recurred": F.col("recurrent_warning").cast("int"),
        "never": F.col("first_warning_day").isNull().cast("int"),
    }
    for d in days:
        columns[f"first_{d}"] = F.coalesce(F.col("first_warning_day") == d, F.lit(False)).cast("int")
    pairs = [(s, i) for s, start in STRATEGIES.items() for i in range(start, last + 1)]
    for s, i in pairs:
        state, y = strategy_state(bits, i, s, last), F.col(f"day{days[i]}_label") == 1
        columns[f"tp_{s}_{i}"] = (state & y).cast("int")
        columns[f"fp_{s}_{i}"] = (state & ~y).cast("int")
        columns[f"fn_{s}_{i}"] = (~state & y).cast("int")
    out = trajectories.select(*ENTITY_KEYS, *[c.cast("long").alias(n) for n, c in columns.items()])
    return out, list(columns), pairs


def _strategy_values(pairs: Sequence[tuple[str, int]], days: Sequence[int], skip_first: bool) -> Column:
    entries = []
    for s, i in pairs:
        if skip_first and i == 0:
            continue
        tp, fp, fn = (F.col(f"{c}_{s}_{i}") for c in ("tp", "fp", "fn"))
        for name, value in (
            ("precision", ratio(tp, tp + fp)),
            ("recall", ratio(tp, tp + fn)),
            ("f1", ratio(2 * tp, 2 * tp + fp + fn)),
            ("false_positives_prevented", (F.col(f"fp_single_{i}") - fp).cast("double")),
            ("true_positives_lost", (F.col(f"tp_single_{i}") - tp).cast("double")),
        ):
            entries.append(
                F.struct(
                    F.lit(s).alias("strategy"),
                    F.lit(int(days[i])).alias("observation_day"),
                    F.lit(name).alias("metric"),
                    value.alias("value"),
                )
            )
    return F.array(*entries)


def _plain_values(values: dict[str, Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(None).cast("string").alias("strategy"),
                F.lit(None).cast("int").alias("observation_day"),
                F.lit(n).alias("metric"),
                c.cast("double").alias("value"),
            )
            for n, c in values.items()
        ]
    )


_STABILITY = {
    "warning_persistence_rate": ("persisted", "warned"),
    "warning_reversal_rate": ("reversed", "n"),
    "recurrent_warning_rate": ("recurred", "n"),
}


def trajectory_intervals(trajectories: DataFrame, days: Sequence[int], samples: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of stability rates and strategy outcomes, resampling trajectories."""
    stats, columns, pairs = _trajectory_sums(trajectories, days)
    sums = weighted_sums(stats, ENTITY_KEYS, [], columns, samples, seed)
    plain = _plain_values({n: ratio(F.col(a), F.col(b)) for n, (a, b) in _STABILITY.items()})
    both = F.concat(plain, _strategy_values(pairs, days, skip_first=True))
    long = sums.select("sample", F.explode(both).alias("v")).select("sample", "v.*")
    return intervals(long, ["strategy", "observation_day", "metric"], samples)


def _lower_medians(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted lower medians per sample of whole-day values (few distinct), from their weights ``w``."""
    part = W.partitionBy("sample", *by)
    upto = F.sum("w").over(part.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("w").over(part)
    return (
        counted.select("sample", *by, "value", upto.alias("c"), total.alias("t"))
        .where(F.col("c") >= F.col("t") / 2)
        .groupBy("sample", *by)
        .agg(F.min("value").cast("double").alias("value"))
    )


def reporting_intervals(trajectories: DataFrame, days: Sequence[int], samples: int = 1000, seed: int = 42) -> DataFrame:
    """Reporting estimates resampled by trajectory and by entity across courses."""
    stats, columns, pairs = _trajectory_sums(trajectories, days)
    bits = F.col("warning_sequence")
    start = F.col("episode_start_day")
    single = first_strategy_day(bits, "single", days)
    day_values = []
    for s in STRATEGIES:
        alert = first_strategy_day(bits, s, days)
        day_values.append((s, "median_episode_lead_time", F.when(alert < start, start - alert)))
        if s in CONFIRMING:
            day_values.append((s, "confirmation_delay", alert - single))
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), F.lit(m).alias("metric"), v.cast("long").alias("value"))
            for s, m, v in day_values
        ]
    )
    by_day = trajectories.select(*ENTITY_KEYS, F.explode(entries).alias("e")).select(*ENTITY_KEYS, "e.*")
    shares = {f"first_warning_day_{d}": ratio(F.col(f"first_{d}"), F.col("n")) for d in days}
    shares["never_warned"] = ratio(F.col("never"), F.col("n"))
    results = []
    for unit, keys in (("student_course_trajectory", ENTITY_KEYS), ("strict_student_id", ["entity"])):
        per_unit = stats if keys == ENTITY_KEYS else stats.groupBy("entity").agg(*[F.sum(c).alias(c) for c in columns])
        sums = weighted_sums(per_unit, keys, [], columns, samples, seed)
        values = dict(shares)
        if unit == "strict_student_id":
            values |= {
                "persistence": ratio(F.col("persisted"), F.col("warned")),
                "reversal": ratio(F.col("reversed"), F.col("n")),
                "recurrence": ratio(F.col("recurred"), F.col("n")),
            }
        every = _plain_values(values)
        if unit == "strict_student_id":
            every = F.concat(every, _strategy_values(pairs, days, skip_first=False))
        long = sums.select("sample", F.explode(every).alias("v")).select("sample", "v.*")
        counted = weighted_sums(
            by_day.where("value IS NOT NULL").withColumn("w", F.lit(1)), keys, ["strategy", "metric", "value"], ["w"], samples, seed
        )
        medians = _lower_medians(counted.where("w > 0"), ["strategy", "metric"]).withColumn(
            "observation_day", F.lit(None).cast("int")
        )
        both = long.unionByName(medians.select(*long.columns))
        results.append(
            intervals(both, ["strategy", "observation_day", "metric"], samples).withColumn(
                "bootstrap_unit", F.lit(unit)
            )
        )
    return results[0].unionByName(results[1]).where("valid_samples > 0")


_WORKLOAD_SUMS = [
    "raw_alerts", "positives", "reviewed", "reviewed_positive", "unreviewed_positive", "unresolved",
    "case_count", "episode", "episode_before",
]


def workload_intervals(
    cases: DataFrame,
    events: DataFrame,
    summary: DataFrame,
    samples: int = 1000,
    seed: int = 42,
    policy: str = "f1_focused",
    deduplication: str = "open_case",
) -> DataFrame:
    """Intervals of review measures by trajectory and by entity.

    Only rate and unlimited scenarios of one policy and rule are resampled.
    """
    chosen = summary.where(
        (F.col("threshold_policy") == policy)
        & F.col("capacity_kind").isin("rate", "unlimited")
        & (F.col("deduplication_scenario") == deduplication)
    ).select("scenario_id", "capacity_utilization")
    y, done = F.col("actual_label"), F.col("review_day").isNotNull()
    start = F.col("episode_start_day")
    picked = cases.join(chosen.select("scenario_id"), "scenario_id", "left_semi")
    per_case = picked.groupBy("scenario_id", *ENTITY_KEYS).agg(
        F.count_if(done).alias("reviewed"),
        F.sum(F.when(done, y).otherwise(0)).alias("reviewed_positive"),
        F.sum(F.when(~done, y).otherwise(0)).alias("unreviewed_positive"),
        F.count_if(~done).alias("unresolved"),
        F.count(F.lit(1)).alias("case_count"),
        F.max((start.isNotNull() & F.coalesce(F.col("review_day") < start, F.lit(False))).cast("int")).alias("episode_before"),
    )
    per_event = events.groupBy(*ENTITY_KEYS).agg(
        F.sum(f"{policy}_prediction").alias("raw_alerts"),
        F.sum("actual_label").alias("positives"),
        F.max(start.isNotNull().cast("int")).alias("episode"),
    )
    names = [r.scenario_id for r in chosen.select("scenario_id").distinct().collect()]
    frame = per_event.withColumn("scenario_id", F.explode(F.array(*[F.lit(n) for n in sorted(names)])))
    zero = ["reviewed", "reviewed_positive", "unreviewed_positive", "unresolved", "case_count", "episode_before"]
    records = frame.join(per_case.hint("merge"), ["scenario_id", *ENTITY_KEYS], "left").na.fill(0, zero)
    by_day = picked.where(done).select(
        "scenario_id",
        *ENTITY_KEYS,
        F.explode(
            F.array(
                F.struct(F.lit("median_review_delay").alias("metric"), F.col("review_delay").cast("long").alias("value")),
                F.struct(
                    F.lit("median_useful_lead_time").alias("metric"),
                    F.when(F.col("review_day") < start, start - F.col("review_day")).cast("long").alias("value"),
                ),
            )
        ).alias("e"),
    ).select("scenario_id", *ENTITY_KEYS, "e.*")
    results = []
    for unit, keys in (("student_course_trajectory", ENTITY_KEYS), ("student_id", ["entity"])):
        per_unit = records.groupBy("scenario_id", *keys).agg(*[F.sum(c).alias(c) for c in _WORKLOAD_SUMS])
        # the draw is shared by all scenarios, so units are drawn once
        draws = draw(per_event.select(*keys).distinct(), keys, samples, seed)
        sums = draws.sums(per_unit, ["scenario_id"], _WORKLOAD_SUMS).join(chosen, "scenario_id")
        values = {
            "proportion_alerts_reviewed": ratio(F.col("reviewed"), F.col("raw_alerts")),
            "capacity_utilization": F.col("capacity_utilization"),
            "future_inactive_capture_rate": ratio(F.col("reviewed_positive"), F.col("positives")),
            "capacity_miss_rate": ratio(F.col("unreviewed_positive"), F.col("positives")),
            "unresolved_at_horizon_rate": ratio(F.col("unresolved"), F.col("case_count")),
            "episode_before_start_review_rate": ratio(F.col("episode_before"), F.col("episode")),
        }
        long = _long(sums, ["scenario_id", "sample"], values)
        counted = draws.sums(by_day.where("value IS NOT NULL").withColumn("w", F.lit(1)), ["scenario_id", "metric", "value"], ["w"])
        medians = _lower_medians(counted, ["scenario_id", "metric"])
        both = long.unionByName(medians.select(*long.columns))
        results.append(
            intervals(both, ["scenario_id", "metric"], samples).withColumn("bootstrap_unit", F.lit(unit))
        )
    return results[0].unionByName(results[1]).where("valid_samples > 0")
