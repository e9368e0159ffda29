"""Warning sequences over checkpoints, strategies and inactivity episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import exact_quantiles, running_totals, value_cells
from tidemark.functions.scalars import ratio
from tidemark.operators.metrics import cohens_kappa, confusion, nullable_rates, spearman
from tidemark.operators.outcomes import window_activity
from tidemark.operators.summaries import macro_summary
from tidemark.schema import ENTITY_KEYS, UNIT_KEYS

# Strategy names with the first checkpoint index they need, and
# trajectory class names.
STRATEGIES = {"single": 0, "two_consecutive": 1, "two_of_three": 2, "persistent_or_late": 1}
CONFIRMING = ("two_consecutive", "two_of_three", "persistent_or_late")
NEVER = "Never warned"
RECURRENT = "Recurrent warning"
PERSISTENT = "Persistent warning"
TEMPORARY = "Temporary warning"


def by_day_columns(
    predictions: DataFrame, days: Sequence[int], decision: str, score: str, label: str,
    keys: Sequence[str] = ENTITY_KEYS,
) -> DataFrame:
    """One row per entity with decision, score and label columns per checkpoint."""
    picked = predictions.where(F.col("observation_day").isin([int(d) for d in days]))
    columns = [F.count(F.lit(1)).alias("checkpoint_rows")]
    for d in days:
        at = F.col("observation_day") == d
        columns += [
            F.max(F.when(at, F.col(decision).cast("int"))).alias(f"w{d}"),
            F.max(F.when(at, F.col(score).cast("double"))).alias(f"day{d}_score"),
            F.max(F.when(at, F.col(label).cast("int"))).alias(f"day{d}_label"),
        ]
    return picked.groupBy(*keys).agg(*columns)


def sequence_flags(bits: Column, scores: Sequence[Column], days: Sequence[int], tolerance: float) -> dict[str, Column]:
    """Flags and class of a 0/1 text with one character per checkpoint."""
    days_array = F.array(*[F.lit(int(d)) for d in days])
    ones = F.length(F.replace(bits, F.lit("0"), F.lit("")))
    first = F.when(ones > 0, F.element_at(days_array, F.instr(bits, "1")))
    flips = None
    for i in range(1, len(days)):
        step = (F.substring(bits, i, 1) != F.substring(bits, i + 1, 1)).cast("int")
        flips = step if flips is None else flips + step
    persistent = bits.contains("11")
    recurrent = bits.rlike("10+1")
    temporary = bits.contains("10") & (ones == 1)
    rises = [b - a for a, b in zip(scores, scores[1:])]
    up = down = F.lit(True)
    for r in rises:
        up, down = up & (r > tolerance), down & (r < -tolerance)
    return {
        "warning_sequence": bits,
        "first_warning_day": first,
        "never_warned": ones == 0,
        "warning_count": ones,
        "longest_warning_run": F.array_max(F.transform(F.split(bits, "0"), lambda x: F.length(x))),
        "persisted_to_end": bits.endswith("1") & persistent,
        "warning_reversals": flips,
        "primary_category": F.when(ones == 0, F.lit(NEVER))
        .when(recurrent, F.lit(RECURRENT))
        .when(persistent, F.lit(PERSISTENT))
        .when(temporary, F.lit(TEMPORARY))
        .otherwise(F.concat(F.lit("First warned Day "), first.cast("string"))),
        "persistent_warning": persistent,
        "temporary_warning": temporary,
        "recurrent_warning": recurrent,
        "alternating_warning": flips == len(days) - 1,
        "warning_escalation": up,
        "warning_deescalation": down,
    }


def trajectory_table(
    predictions: DataFrame,
    days: Sequence[int],
    decision: str,
    score: str = "calibrated_output",
    label: str = "actual_label",
    tolerance: float = 0.05,
) -> DataFrame:
    """Sequence, flags, scores and labels of entities seen at every checkpoint."""
    wide = by_day_columns(predictions, days, decision, score, label)
    complete = F.col("checkpoint_rows") == len(days)
    for d in days:
        complete = complete & F.col(f"w{d}").isNotNull()
    bits = F.concat(*[F.col(f"w{d}").cast("string") for d in days])
    flags = sequence_flags(bits, [F.col(f"day{d}_score") for d in days], days, tolerance)
    return wide.where(complete).select(
        *ENTITY_KEYS,
        *[c.alias(n) for n, c in flags.items()],
        *[f"day{d}_score" for d in days],
        *[f"day{d}_label" for d in days],
    )


def inactivity_episodes(
    daily: DataFrame,
    entities: DataFrame,
    course_lengths: DataFrame,
    start_day: int = 15,
    quiet_days: int = 14,
) -> DataFrame:
    """First run of ``quiet_days`` inactive days on or after ``start_day``.

    Runs are gaps between neighbouring active days of one entity; activity
    before the start is ignored and gaps are cut at the course end.
    """
    ends = course_lengths.select(*UNIT_KEYS, (F.col("length_days") - 1).alias("end_day"))
    members = entities.select(*ENTITY_KEYS).distinct().join(ends, UNIT_KEYS, "left").withColumn(
        "end_day", F.coalesce("end_day", F.lit(-1))
    )
    order = W.partitionBy(*ENTITY_KEYS).orderBy("day")
    active = (
        daily.where(F.col("day") >= start_day)
        .select(*ENTITY_KEYS, "day")
        .join(ends, UNIT_KEYS)
        .where(F.col("day") <= F.col("end_day"))
        .withColumn("next_day", F.coalesce(F.lead("day").over(order), F.col("end_day") + 1))
        .groupBy(*ENTITY_KEYS)
        .agg(
            F.min("day").alias("first_day"),
            F.min(
                F.when(F.col("next_day") - F.col("day") - 1 >= quiet_days, F.col("day") + 1)
            ).alias("later_start"),
        )
    )
    first_stop = F.coalesce(F.col("first_day"), F.col("end_day") + 1)
    opening = F.when(first_stop - start_day >= quiet_days, F.lit(start_day))
    begin = F.coalesce(opening, F.col("later_start"))
    return members.join(active, ENTITY_KEYS, "left").select(
        *ENTITY_KEYS,
        (begin.isNotNull() | (F.col("end_day") >= start_day + quiet_days - 1)).alias("episode_eligible"),
        begin.alias("episode_start_day"),
        (begin + quiet_days - 1).alias("episode_end_day"),
    )


def attach_episodes(trajectories: DataFrame, episodes: DataFrame, days: Sequence[int]) -> DataFrame:
    """Add episode columns, first warning before the start, lead time and timing."""
    joined = trajectories.join(episodes, ENTITY_KEYS, "left")
    start = F.col("episode_start_day")
    prior = F.coalesce(
        *[
            F.when(
                (F.substring("warning_sequence", i + 1, 1) == "1") & (start.isNull() | (F.lit(d) < start)),
                F.lit(int(d)),
            )
            for i, d in enumerate(days)
        ]
    )
    return joined.withColumn("first_prior_warning_day", prior).withColumns(
        {
            "warning_lead_time": start - F.col("first_prior_warning_day"),
            "warning_timing": F.when(F.col("first_prior_warning_day").isNotNull(), F.lit("before_start"))
            .when(start.isNotNull() & F.col("first_warning_day").isNotNull(), F.lit("late"))
            .otherwise(F.lit("never_warned")),
        }
    )


def strategy_state(bits: Column, index: int, strategy: str, last: int) -> Column:
    """Whether a strategy alerts at checkpoint ``index``."""
    if index < STRATEGIES.get(strategy, last + 1):
        raise ValueError(f"{strategy} cannot be asked at checkpoint {index}")

    def bit(i: int) -> Column:
        return F.substring(bits, i + 1, 1) == "1"

    if strategy == "single":
        return bit(index)
    if strategy == "two_of_three":
        return (
            bit(index).cast("int") + bit(index - 1).cast("int") + bit(index - 2).cast("int")
        ) >= 2
    pair = bit(index) & bit(index - 1)
    if strategy == "persistent_or_late" and index == last:
        return pair | bit(index)
    return pair


def strategy_decisions(trajectories: DataFrame, days: Sequence[int], keep: Sequence[str] = UNIT_KEYS) -> DataFrame:
    """Long table: one row per trajectory, valid checkpoint and strategy."""
    bits, last = F.col("warning_sequence"), len(days) - 1
    entries = [
        F.struct(
            F.lit(int(d)).alias("observation_day"),
            F.lit(s).alias("strategy"),
            F.lit(int(days[first])).alias("earliest_possible_day"),
            strategy_state(bits, i, s, last).cast("int").alias("decision"),
            F.col(f"day{d}_label").alias("actual_label"),
        )
        for i, d in enumerate(days)
        for s, first in STRATEGIES.items()
        if i >= first
    ]
    return trajectories.select(*keep, F.explode(F.array(*entries)).alias("x")).select(*keep, "x.*")


def first_strategy_day(bits: Column, strategy: str, days: Sequence[int]) -> Column:
    last = len(days) - 1
    return F.coalesce(
        *[
            F.when(strategy_state(bits, i, strategy, last), F.lit(int(d)))
            for i, d in enumerate(days)
            if i >= STRATEGIES[strategy]
        ]
    )


def strategy_outcomes(trajectories: DataFrame, days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Warning metrics per day and strategy, with gains and losses against ``single``."""
    by = list(by)
    slices = [*by, "observation_day", "strategy"]
    decided = strategy_decisions(trajectories, days, by)
    out = nullable_rates(confusion(decided, slices, "actual_label", "decision"))
    same_day = W.partitionBy(*by, "observation_day")

    def single(c: str) -> Column:
        return F.max(F.when(F.col("strategy") == "single", F.col(c))).over(same_day)

    first = F.create_map(*[F.lit(x) for s, i in STRATEGIES.items() for x in (s, int(days[i]))])
    return out.withColumns(
        {
            "warnings_prevented": single("warnings") - F.col("warnings"),
            "false_positives_prevented": single("false_positives") - F.col("false_positives"),
            "true_positives_lost": single("true_positives") - F.col("true_positives"),
            "false_negatives_added": F.col("false_negatives") - single("false_negatives"),
            "earliest_possible_day": first[F.col("strategy")],
        }
    )


def course_macro_summary(course_outcomes: DataFrame) -> DataFrame:
    metrics = (
        "alert_rate", "precision", "recall", "f1", "false_positive_rate",
        "false_positives_prevented", "true_positives_lost",
    )
    return macro_summary(course_outcomes, ["observation_day", "strategy"], metrics)


def adjacent_pairs(
    predictions: DataFrame, days: Sequence[int], decision: str,
    score: str = "calibrated_output", label: str = "actual_label",
) -> DataFrame:
    """Entities seen at two neighbouring checkpoints, one row per pair."""
    wide = by_day_columns(predictions, days, decision, score, label)
    entries = [
        F.struct(
            F.lit(int(a)).alias("from_day"),
            F.lit(int(b)).alias("to_day"),
            F.col(f"w{a}").alias("from_decision"),
            F.col(f"w{b}").alias("to_decision"),
            F.col(f"day{a}_score").alias("from_score"),
            F.col(f"day{b}_score").alias("to_score"),
            F.col(f"day{b}_label").alias("to_label"),
        )
        for a, b in zip(days, days[1:])
    ]
    return (
        wide.select(*ENTITY_KEYS, F.explode(F.array(*entries)).alias("p"))
        .select(*ENTITY_KEYS, "p.*")
        .where("from_decision IS NOT NULL AND to_decision IS NOT NULL")
    )


def transition_table(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Counts, later rates and score changes per transition."""
    change = F.col("to_score") - F.col("from_score")
    rows = pairs.withColumns(
        {
            "change": change,
            "transition": F.concat(
                F.col("from_decision").cast("string"), F.lit("->"), F.col("to_decision").cast("string")
            ),
        }
    )
    by = ["from_day", "to_day", "transition"]
    y, w = F.col("to_label"), F.col("to_decision")
    c = F.col("change")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(y).alias("positives"),
        F.sum(w).alias("warned"),
        F.sum(y * w).alias("hits"),
        F.avg("to_score").alias("mean_later_score"),
        F.avg((c > tolerance).cast("double")).alias("increasing"),
        F.avg((c < -tolerance).cast("double")).alias("decreasing"),
        F.avg((F.abs(c) <= tolerance).cast("double")).alias("stable"),
    )
    quartiles = exact_quantiles(rows, by, "change", (0.25, 0.5, 0.75))
    total = F.sum("count").over(W.partitionBy("from_day", "to_day"))
    return sums.join(quartiles, by).select(
        *by,
        "count",
        ratio(F.col("count"), total).alias("percentage"),
        ratio(F.col("positives"), F.col("count")).alias("later_positive_rate"),
        "mean_later_score",
        ratio(F.col("hits"), F.col("warned")).alias("later_precision"),
        ratio(F.col("hits"), F.col("positives")).alias("later_recall_contribution"),
        F.col("quantiles")[1].alias("median_score_change"),
        F.col("quantiles")[0].alias("score_change_q1"),
        F.col("quantiles")[2].alias("score_change_q3"),
        "increasing",
        "decreasing",
        "stable",
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Kappa of decisions and rank correlation of scores per checkpoint pair."""
    by = ["from_day", "to_day"]
    return cohens_kappa(pairs, by, "from_decision", "to_decision").join(
        spearman(pairs, by, "from_score", "to_score"), by
    )


def disappearances(pairs: DataFrame, daily: DataFrame, follow_days: int = 14) -> DataFrame:
    """Activity after warnings that went away at the next checkpoint."""
    gone = pairs.where("from_decision = 1 AND to_decision = 0").select(
        *ENTITY_KEYS, "from_day", "to_day", (F.col("to_day") + follow_days).alias("until_day")
    )
    seen = window_activity(gone, daily, "to_day", "until_day")
    return seen.select(
        *ENTITY_KEYS,
        "from_day",
        "to_day",
        F.col("activity_days").alias("activity_days_after"),
        F.col("clicks").alias("clicks_after"),
        F.when(F.col("activity_days") > 0, F.lit("warning disappeared with subsequent activity"))
        .otherwise(F.lit("warning disappeared without subsequent activity"))
        .alias("classification"),
    )


def stability_rates(trajectories: DataFrame, by: Sequence[str], checkpoints: int, weight: str | None = None) -> DataFrame:
    """Persistence, reversal, recurrence and agreement rates of sequences."""
    w = F.lit(1) if weight is None else F.col(weight)
    bits = F.col("warning_sequence")

    def share(condition: Column, among: Column | None = None) -> Column:
        base = F.lit(True) if among is None else among
        return ratio(F.sum(F.when(base & condition, w).otherwise(0)), F.sum(F.when(base, w).otherwise(0)))

    ones = F.col("warning_count")
    return trajectories.groupBy(*by).agg(
        F.sum(w).cast("long").alias("trajectories"),
        share(bits.contains("11"), ones > 0).alias("warning_persistence_rate"),
        share(F.col("warning_reversals") > 0).alias("warning_reversal_rate"),
        share(F.col("recurrent_warning")).alias("recurrent_warning_rate"),
        share(ones == 1).alias("warned_exactly_once"),
        share(ones >= 2).alias("warned_at_least_twice"),
        share(bits.contains("11")).alias("warned_consecutively"),
        ratio(
            F.sum(w * (F.lit(checkpoints - 1) - F.col("warning_reversals"))), F.sum(w) * (checkpoints - 1)
        ).alias("adjacent_agreement"),
    )


def course_summary(trajectories: DataFrame, days: Sequence[int]) -> DataFrame:
    """Prevalence, stability, first-warning counts and detection per course."""
    bits = F.col("warning_sequence")
    first = F.col("first_warning_day")
    start = F.col("episode_start_day")
    detected = start.isNotNull() & (F.col("warning_timing") == "before_start")
    base = trajectories.groupBy(*UNIT_KEYS).agg(
        *[
            F.avg((F.substring(bits, i + 1, 1) == "1").cast("double")).alias(f"day{d}_warning_prevalence")
            for i, d in enumerate(days)
        ],
        *[F.count_if(first == d).alias(f"first_warned_day{d}") for d in days],
        F.count_if(first.isNull()).alias("first_warned_never"),
        F.count_if(start.isNotNull()).alias("eligible_inactivity_episodes"),
        ratio(F.count_if(detected), F.count_if(start.isNotNull())).alias("episode_detection_rate"),
        # lead times are whole days of one course, so the exact percentile's map is small
        F.percentile(F.when(detected, F.col("warning_lead_time")), 0.5).alias("median_lead_time"),
    )
    return base.join(stability_rates(trajectories, UNIT_KEYS, len(days)), UNIT_KEYS)


def _day_summary(value: Column, prefix: str, suffix: str) -> list[Column]:
    """Median, mean, quartiles and range of whole-day values (few distinct)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        q[1].alias(f"median_{suffix}"),
        F.avg(value).alias(f"mean_{suffix}"),
        q[0].alias(f"{prefix}_q1"),
        q[2].alias(f"{prefix}_q3"),
        F.min(value).alias(f"minimum_{suffix}"),
        F.max(value).alias(f"maximum_{suffix}"),
    ]


def _alerts(trajectories: DataFrame, days: Sequence[int], strategies: Sequence[str]) -> DataFrame:
    bits = F.col("warning_sequence")
    single = first_strategy_day(bits, "single", days)
    entries = [
        F.struct(F.lit(s).alias("strategy"), first_strategy_day(bits, s, days).alias("alert_day"), single.alias("single_day"))
        for s in strategies
    ]
    return trajectories.withColumn("x", F.explode(F.array(*entries))).select(*trajectories.columns, "x.*")


def confirmation_delays(trajectories: DataFrame, days: Sequence[int]) -> DataFrame:
    """Days from the first single warning to each strategy's confirmation."""
    rows = _alerts(trajectories, days, CONFIRMING)
    delay = F.col("alert_day") - F.col("single_day")
    first = F.create_map(*[F.lit(x) for s in CONFIRMING for x in (s, int(days[STRATEGIES[s]]))])
    out = rows.groupBy("strategy").agg(
        F.count("alert_day").alias("confirmed_trajectories"),
        *_day_summary(delay, "confirmation_delay", "confirmation_delay"),
        F.count_if(F.col("alert_day").isNull()).alias("trajectories_never_confirmed"),
    )
    return out.withColumn("earliest_valid_day", first[F.col("strategy")])


def episode_timing(trajectories: DataFrame, days: Sequence[int]) -> DataFrame:
    """Alerts before, after or without an episode per strategy; late ones earn no lead."""
    rows = _alerts(trajectories, days, list(STRATEGIES))
    start, alert = F.col("episode_start_day"), F.col("alert_day")
    before = start.isNotNull() & (alert < start)
    out = rows.groupBy("strategy").agg(
        F.count("episode_start_day").alias("eligible_episodes"),
        F.count_if(before).alias("warned_before_episode_start"),
        F.count_if(start.isNotNull() & (alert >= start)).alias("warned_after_episode_start"),
        F.count_if(start.isNotNull() & alert.isNull()).alias("never_warned"),
        F.count_if(start.isNull()).alias("no_eligible_episode"),
        F.count_if(start.isNull() & alert.isNotNull()).alias("false_alert_trajectories_without_episode"),
        *_day_summary(F.when(before, start - alert), "lead_time", "lead_time"),
        F.percentile(F.when(before, alert - F.col("single_day")), 0.5).alias("median_delay_relative_to_single"),
    )
    single = F.max(F.when(F.col("strategy") == "single", F.col("warned_before_episode_start"))).over(
        W.partitionBy(F.lit(0))
    )
    return out.withColumn(
        "useful_warnings_lost_relative_to_single", single - F.col("warned_before_episode_start")
    )


def episode_summary(trajectories: DataFrame) -> DataFrame:
    """Mutually exclusive episode outcomes; alerts without episode stay apart."""
    start, timing = F.col("episode_start_day"), F.col("warning_timing")
    has = start.isNotNull()
    return trajectories.agg(
        F.count_if(has).alias("eligible_episode_count"),
        F.count_if(has & (timing == "before_start")).alias("warned_before_episode_start"),
        F.count_if(has & (timing == "late")).alias("warned_after_episode_start"),
        F.count_if(has & ~timing.isin("before_start", "late")).alias("eligible_episode_never_warned"),
        F.count_if(~has).alias("no_eligible_episode"),
        F.count_if(~has & F.col("warning_sequence").contains("1")).alias(
            "false_alert_trajectory_without_episode"
        ),
    )


def sequence_histogram(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("warning_sequence", "primary_category").agg(
        F.count(F.lit(1)).alias("trajectories")
    )


def first_warning_histogram(trajectories: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("first_warning_day").cast("string"), F.lit("Never"))
    return trajectories.groupBy(label.alias("first_warning")).agg(F.count(F.lit(1)).alias("trajectories"))


def start_end_patterns(predictions: DataFrame, days: Sequence[int], decision: str, keys: Sequence[str] = ENTITY_KEYS) -> DataFrame:
    """Pattern from first to last available checkpoint; needs at least two."""
    rows = predictions.where(F.col("observation_day").isin([int(d) for d in days])).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.min(F.col(decision)).alias("low"),
        F.max(F.col(decision)).alias("high"),
        F.min_by(F.col(decision), F.col("observation_day")).alias("first"),
        F.max_by(F.col(decision), F.col("observation_day")).alias("last"),
    )
    pattern = (
        F.when(F.col("low") == 1, "consistently_high")
        .when(F.col("high") == 0, "consistently_low")
        .when((F.col("first") == 0) & (F.col("last") == 1), "low_to_high")
        .when((F.col("first") == 1) & (F.col("last") == 0), "high_to_low")
        .otherwise("mixed")
    )
    return rows.where("observation_count >= 2").select(
        *keys, pattern.alias("trajectory_pattern"), "observation_count"
    )


def representative_rows(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row of each slice nearest its median, ties by ``tie``."""
    by = list(by)
    median = exact_quantiles(df, by, value, (0.5,)).select(*by, F.col("quantiles")[0].alias("median"))
    rest = [c for c in df.columns if c not in by]
    nearest = F.min(
        F.struct(F.abs(F.col(value) - F.col("median")).alias("gap"), *[F.col(t) for t in tie], F.struct(*rest).alias("row"))
    )
    return df.join(median, by).groupBy(*by).agg(nearest.alias("best")).select(*by, "best.row.*")


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Smallest value whose cumulative weight reaches half the total."""
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg(F.sum(weight).alias("w"))
    )
    run = running_totals(value_cells(counts, by, "v"), by, "v", F.col("cell"), ["w"])
    return run.where(F.col("cum_w") >= F.col("all_w") / 2).groupBy(*by).agg(F.min("v").alias("median"))
