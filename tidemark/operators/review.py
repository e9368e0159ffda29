"""Capacity-limited review of alerts over a few checkpoints.

Every alerting entity (or, when each alert opens its own case, every alert) is
one *lane* row per scenario.  A checkpoint step updates lanes with column
expressions and writes them.  Which cases are reviewed follows from one row per
slice, the last place that the capacity reaches, so lanes are never shuffled;
labels are never read by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import score_cell, value_percentiles
from tidemark.functions.scalars import ratio
from tidemark.schema import ENTITY_KEYS, UNIT_KEYS
from tidemark.session import written

# Rule and priority names and the hybrid weights.
EVERY_ALERT = "every_alert"
OPEN_CASE = "open_case"
PRIORITIES = ("highest_score", "persistent_warning", "inactivity_gap", "earliest_first", "hybrid")
HYBRID_WEIGHTS = (0.5, 0.3, 0.2)
UNLIMITED, RATE, FIXED = "unlimited", "rate", "fixed"
_NO_LIMIT = 2**60


@dataclass(frozen=True)
class Scenario:
    """One combination of alert policy, capacity, de-duplication and priority."""

    policy: str
    capacity_kind: str
    capacity_value: float | None
    deduplication: str
    priority: str

    @property
    def capacity(self) -> str:
        if self.capacity_kind == UNLIMITED:
            return UNLIMITED
        if self.capacity_kind == RATE:
            return f"rate_{self.capacity_value:.2f}"
        return f"fixed_{self.capacity_value:g}"

    @property
    def name(self) -> str:
        return "|".join((self.policy, self.capacity, self.deduplication, self.priority))

    @property
    def cooldown(self) -> int | None:
        if self.deduplication.startswith("cooldown_"):
            return int(self.deduplication.removeprefix("cooldown_"))
        return None

    def validate(self) -> None:
        if self.priority not in PRIORITIES:
            raise ValueError(f"unknown priority {self.priority}")
        if self.deduplication not in (EVERY_ALERT, OPEN_CASE) and self.cooldown is None:
            raise ValueError(f"unknown rule {self.deduplication}")
        if self.capacity_kind not in (UNLIMITED, RATE, FIXED):
            raise ValueError(f"unknown capacity {self.capacity_kind}")


SCENARIO_COLUMNS = [
    "scenario_id", "threshold_policy", "capacity_scenario", "capacity_kind", "capacity_value",
    "deduplication_scenario", "priority_policy",
]
SLICE = ["scenario_id", *UNIT_KEYS]


def _scenario_array(scenarios: Sequence[Scenario]) -> Column:
    for s in scenarios:
        s.validate()
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario_id"),
                F.lit(s.policy).alias("threshold_policy"),
                F.lit(s.capacity).alias("capacity_scenario"),
                F.lit(s.capacity_kind).alias("capacity_kind"),
                F.lit(None if s.capacity_value is None else float(s.capacity_value)).cast("double").alias("capacity_value"),
                F.lit(s.deduplication).alias("deduplication_scenario"),
                F.lit(s.priority).alias("priority_policy"),
                F.lit(s.cooldown).cast("int").alias("cooldown"),
            )
            for s in scenarios
        ]
    )


def capacity_count(eligible: Column, kind: Column, value: Column) -> Column:
    """Reviews available with a non-empty queue: rates floor, but at least one."""
    floor = F.floor(eligible * value)
    return (
        F.when(eligible == 0, F.lit(0))
        .when(kind == UNLIMITED, F.lit(_NO_LIMIT))
        .when(kind == RATE, F.greatest(floor, F.when(value > 0, F.lit(1)).otherwise(F.lit(0))))
        .otherwise(F.greatest(value, F.lit(0.0)))
        .cast("long")
    )


def _with_hybrid(lanes: DataFrame) -> DataFrame:
    """``lanes`` of the hybrid priority with ``hybrid``; null where no case is open.

    Open cases are counted per score, persistence and gap; the blend is worked
    out once per such combination and joined to the lanes.
    """
    parts = ["score", "alerting_checkpoints", "gap_rank_value"]
    lanes = lanes.withColumn("gap_rank_value", F.when(F.col("open"), F.coalesce("gap", F.lit(-1))))
    counted = written(
        lanes.where("open").groupBy(*SLICE, *parts).agg(F.count(F.lit(1)).alias("cases_of")), "review-combinations"
    )
    blend, out = None, counted
    for part, share in zip(parts, HYBRID_WEIGHTS):
        few = part != "score"
        cell = None if few else score_cell(F.col("score"))
        out = out.join(value_percentiles(counted, SLICE, part, f"p_{part}", cell, few, "cases_of"), [*SLICE, part])
        term = F.lit(share) * F.col(f"p_{part}")
        blend = term if blend is None else blend + term
    values = written(out.select(*SLICE, *parts, blend.alias("hybrid")), "review-hybrid")
    return lanes.join(values, [*SLICE, *parts], "left").drop("gap_rank_value")


def priority_order() -> tuple[Column, list[Column]]:
    """Cell and total order of open cases for their ``priority_policy``.

    Only alert history decides the order; labels and attributes do not appear.
    """
    kind = F.col("priority_policy")
    score, gap, hybrid = F.col("score"), F.col("gap"), F.col("hybrid")
    n, consecutive, origin = F.col("alerting_checkpoints"), F.col("consecutive"), F.col("origin_day")
    by_score = F.lit(5000) - score_cell(score)
    span = F.lit(10_000)
    cell = (
        F.when(kind == "highest_score", by_score)
        # a cell need only ascend with the order: longer runs share one and are ordered inside it
        .when(
            kind == "persistent_warning",
            by_score - (n.cast("long") * (1 << 20) + F.least(consecutive.cast("long"), F.lit((1 << 20) - 1))) * span,
        )
        .when(
            kind == "inactivity_gap",
            F.when(gap.isNull(), F.lit(10**10)).otherwise((100_000 - gap) * span) + by_score,
        )
        .when(kind == "earliest_first", origin * span + by_score)
        .otherwise(F.floor(-hybrid * 4096))
    ).cast("long")
    first = (
        F.when(kind == "persistent_warning", -n.cast("double"))
        .when(kind == "inactivity_gap", gap.isNull().cast("double"))
        .when(kind == "earliest_first", origin.cast("double"))
        .when(kind == "hybrid", -hybrid)
        .otherwise(F.lit(0.0))
    )
    second = (
        F.when(kind == "persistent_warning", -consecutive.cast("double"))
        .when(kind == "inactivity_gap", -F.coalesce(gap, F.lit(0)).cast("double"))
        .otherwise(F.lit(0.0))
    )
    return cell, [first, second, -score, origin, F.col("entity"), F.col("lane")]


def _alerts_by_day(events: DataFrame, policies: Sequence[str], days: Sequence[int]) -> DataFrame:
    """One row per entity with score, gap, label and decisions of each checkpoint."""
    columns = []
    for i, d in enumerate(days):
        at = F.col("observation_day") == d
        columns += [
            F.max(F.when(at, F.col("calibrated_output"))).alias(f"s{i}"),
            F.max(F.when(at, F.col("current_inactivity_gap"))).cast("int").alias(f"g{i}"),
            F.max(F.when(at, F.col("actual_label"))).cast("int").alias(f"y{i}"),
            *[
                F.max(F.when(at, F.col(f"{p}_prediction"))).cast("int").alias(f"{p}_{i}")
                for p in policies
            ],
        ]
    return events.groupBy(*ENTITY_KEYS).agg(*columns, F.max("episode_start_day").alias("episode_start_day"))


def _lanes(wide: DataFrame, scenarios: Sequence[Scenario], policies: Sequence[str], days: Sequence[int]) -> DataFrame:
    """One row per scenario and lane with per-checkpoint alert columns."""
    alerted = F.array(*[F.lit(i) for i in range(1, len(days) + 1)])
    lanes = F.when(F.col("deduplication_scenario") == EVERY_ALERT, alerted).otherwise(F.array(F.lit(0)))
    kept = [*ENTITY_KEYS, "episode_start_day", *[f"{c}{i}" for c in "sgy" for i in range(len(days))]]
    exploded = (
        wide.withColumn("x", F.explode(_scenario_array(scenarios)))
        .select("*", "x.*")
        .withColumn("lane", F.explode(lanes))
    )

    def alert(i: int) -> Column:
        hit = None
        for p in policies:
            c = F.col(f"{p}_{i}") == 1
            hit = F.when(F.col("threshold_policy") == p, c) if hit is None else hit.when(F.col("threshold_policy") == p, c)
        return F.coalesce(hit, F.lit(False)) & F.col("lane").isin(0, i + 1)

    any_alert = None
    for i in range(len(days)):
        any_alert = alert(i) if any_alert is None else any_alert | alert(i)
    return exploded.where(any_alert).select(
        *SCENARIO_COLUMNS, "cooldown", *kept, "lane", *[alert(i).alias(f"a{i}") for i in range(len(days))]
    )


_CASE = (
    "struct<origin_day:int,origin_score:double,origin_label:int,recent_day:int,score:double,gap:int,"
    "alerting_checkpoints:int,consecutive:int,review_day:int>"
)


def allocate_reviews(
    events: DataFrame, scenarios: Sequence[Scenario], days: Sequence[int], step_days: int = 14
) -> DataFrame:
    """Final lane rows with closed and open cases and per-checkpoint flags.

    ``events`` needs the entity keys, ``observation_day``, ``calibrated_output``,
    ``current_inactivity_gap``, ``actual_label``, ``episode_start_day`` and the
    ``*_prediction`` columns.  Lanes are written at every checkpoint.  Scenarios
    do not touch each other: those of the hybrid priority, which first rank their
    whole queue, are stepped apart.
    """
    policies = sorted({s.policy for s in scenarios})
    alerts = written(_alerts_by_day(events, policies, days), "review-alerts")
    eligible = events.groupBy(*UNIT_KEYS).agg(
        *[F.count_if(F.col("observation_day") == d).alias(f"n{i}") for i, d in enumerate(days)]
    )
    capacity = written(
        eligible.withColumn("x", F.explode(_scenario_array(scenarios))).select(
            "x.scenario_id",
            *UNIT_KEYS,
            *[
                capacity_count(F.col(f"n{i}"), F.col("x.capacity_kind"), F.col("x.capacity_value")).alias(f"available{i}")
                for i in range(len(days))
            ],
        ),
        "review-capacity",
    )
    out = None
    for hybrid in (False, True):
        some = [s for s in scenarios if (s.priority == "hybrid") == hybrid]
        if some:
            state = _start(_lanes(alerts, some, policies, days))
            for i, day in enumerate(days):
                state = _checkpoint(state, capacity, i, int(day), step_days, hybrid)
            out = state if out is None else out.unionByName(state)
    return out


def _start(lanes: DataFrame) -> DataFrame:
    null_int = F.lit(None).cast("int")
    return lanes.withColumns(
        {
            "open": F.lit(False),
            "origin_day": null_int,
            "origin_score": F.lit(None).cast("double"),
            "origin_label": null_int,
            "recent_day": null_int,
            "score": F.lit(None).cast("double"),
            "gap": null_int,
            "alerting_checkpoints": F.lit(0),
            "consecutive": F.lit(0),
            "previous_alert": null_int,
            "last_review": null_int,
            "cases": F.array().cast(f"array<{_CASE}>"),
        }
    )


def _checkpoint(
    state: DataFrame, capacity: DataFrame, i: int, day: int, step_days: int, hybrid: bool
) -> DataFrame:
    """Lanes after the checkpoint; only a map over written lanes is left to do."""
    opened = _open_cases(state, i, day, step_days)
    opened = _with_hybrid(opened) if hybrid else opened.withColumn("hybrid", F.lit(None).cast("double"))
    opened = written(opened, f"review-lanes-{i}")
    cell, order = priority_order()
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    queue = opened.where("open").select(*SLICE, cell.alias("cell"), place.alias("place")).where("cell IS NOT NULL")
    last = _last_places(queue, capacity.select(*SLICE, F.col(f"available{i}").alias("available")))
    joined = opened.join(last, SLICE, "left").withColumn("cell", cell)
    inside = (F.col("cell") < F.col("last_cell")) | (
        (F.col("cell") == F.col("last_cell")) & F.coalesce(place <= F.col("last_place"), F.lit(True))
    )
    reviewed = joined.withColumn(f"reviewed{i}", F.col("open") & F.coalesce(inside, F.lit(False)))
    return _close_cases(reviewed.drop("cell", "last_cell", "last_place", "hybrid"), i, day)


def _last_places(queue: DataFrame, capacity: DataFrame) -> DataFrame:
    """Per slice the cell in which the capacity ends, and the last place where it ends inside the cell.

    Only the cases of such a cell are ordered.  Slices without reviews do not appear.
    """
    before = W.partitionBy(*SLICE).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        queue.groupBy(*SLICE, "cell")
        .agg(F.count(F.lit(1)).alias("inside"))
        .withColumn("ahead", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    )
    ends = written(
        cells.join(capacity, SLICE)
        .where("ahead < available")
        .groupBy(*SLICE)
        .agg(
            F.max("cell").alias("last_cell"),
            F.max_by(F.when(F.col("available") - F.col("ahead") < F.col("inside"), F.col("available") - F.col("ahead")), "cell").alias("wanted"),
        ),
        "review-cells",
    )
    order = W.partitionBy(*SLICE).orderBy(*[f"place.o{k}" for k in range(len(queue.schema["place"].dataType))])
    cut = (
        queue.join(ends.where("wanted IS NOT NULL"), SLICE)
        .where(F.col("cell") == F.col("last_cell"))
        .withColumn("nth", F.row_number().over(order))
        .where("nth = wanted")
        .select(*SLICE, F.col("place").alias("last_place"))
    )
    return written(ends.drop("wanted").join(cut, SLICE, "left"), "review-places")


def _open_cases(state: DataFrame, i: int, day: int, step_days: int) -> DataFrame:
    alert, was_open = F.col(f"a{i}"), F.col("open")
    waited = F.lit(day) - F.col("last_review")
    blocked = F.col("last_review").isNotNull() & (
        (F.col("deduplication_scenario") == OPEN_CASE) | F.coalesce(waited < F.col("cooldown"), F.lit(False))
    )
    marked = state.withColumns(
        {
            f"opening{i}": was_open,
            f"merged{i}": alert & was_open,
            f"suppressed{i}": alert & ~was_open & blocked,
            f"new{i}": alert & ~was_open & ~blocked,
        }
    )
    merged, new = F.col(f"merged{i}"), F.col(f"new{i}")
    touched = merged | new
    today = F.lit(day)
    in_row = F.coalesce(F.col("previous_alert") == day - step_days, F.lit(False))
    return marked.withColumns(
        {
            "open": was_open | new,
            "origin_day": F.when(new, today).otherwise(F.col("origin_day")),
            "origin_score": F.when(new, F.col(f"s{i}")).otherwise(F.col("origin_score")),
            "origin_label": F.when(new, F.col(f"y{i}")).otherwise(F.col("origin_label")),
            "recent_day": F.when(touched, today).otherwise(F.col("recent_day")),
            "score": F.when(touched, F.col(f"s{i}")).otherwise(F.col("score")),
            "gap": F.when(touched, F.col(f"g{i}")).otherwise(F.col("gap")),
            "alerting_checkpoints": F.when(new, F.lit(1))
            .when(merged, F.col("alerting_checkpoints") + 1)
            .otherwise(F.col("alerting_checkpoints")),
            "consecutive": F.when(merged & in_row, F.col("consecutive") + 1)
            .when(touched, F.lit(1))
            .otherwise(F.col("consecutive")),
            "previous_alert": F.when(alert, today).otherwise(F.col("previous_alert")),
        }
    ).withColumn(f"waiting{i}", F.col("open"))


def _close_cases(state: DataFrame, i: int, day: int) -> DataFrame:
    done, today = F.col(f"reviewed{i}"), F.lit(day)
    closed = F.struct(
        "origin_day", "origin_score", "origin_label", "recent_day", "score", "gap",
        "alerting_checkpoints", "consecutive", today.alias("review_day"),
    ).cast(_CASE)
    return state.withColumns(
        {
            f"delay{i}": F.when(done, today - F.col("origin_day")),
            "cases": F.when(done, F.array_append("cases", closed)).otherwise(F.col("cases")),
            "last_review": F.when(done, today).otherwise(F.col("last_review")),
            "open": F.col("open") & ~done,
        }
    )


def review_cases(lanes: DataFrame) -> DataFrame:
    """One row per case; open ones end as ``unresolved_at_horizon``."""
    still = F.struct(
        "origin_day", "origin_score", "origin_label", "recent_day", "score", "gap",
        "alerting_checkpoints", "consecutive", F.lit(None).cast("int").alias("review_day"),
    ).cast(_CASE)
    every = F.when(F.col("open"), F.array_append("cases", still)).otherwise(F.col("cases"))
    return lanes.select(
        *SCENARIO_COLUMNS, *ENTITY_KEYS, "episode_start_day", F.explode(every).alias("c")
    ).select(
        *SCENARIO_COLUMNS,
        *ENTITY_KEYS,
        F.col("c.origin_day").alias("alert_origin_day"),
        F.col("c.recent_day").alias("most_recent_alert_day"),
        F.col("c.origin_score").alias("saved_score_at_origin"),
        F.col("c.score").alias("most_recent_score"),
        F.col("c.alerting_checkpoints").alias("alerting_checkpoints"),
        F.col("c.consecutive").alias("consecutive_alert_count"),
        F.col("c.gap").alias("current_inactivity_gap"),
        F.col("c.origin_label").alias("actual_label"),
        F.col("c.review_day").alias("review_day"),
        (F.col("c.review_day") - F.col("c.origin_day")).alias("review_delay"),
        F.when(F.col("c.review_day").isNull(), "unresolved_at_horizon").otherwise("reviewed").alias("resolution_status"),
        "episode_start_day",
    )


def _day_quartiles(value: Column, rows: Column | int = 1) -> Column:
    """Quartiles of whole-day values; few distinct, so the exact map is small."""
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), rows)


def review_checkpoints(
    lanes: DataFrame, events: DataFrame, scenarios: Sequence[Scenario], days: Sequence[int]
) -> DataFrame:
    """Queue counts per scenario, course and checkpoint that has rows."""
    frame = (
        events.where(F.col("observation_day").isin([int(d) for d in days]))
        .groupBy(*UNIT_KEYS, "observation_day")
        .agg(F.count(F.lit(1)).alias("eligible_students"))
        .withColumn("x", F.explode(_scenario_array(scenarios)))
        .select(*UNIT_KEYS, "observation_day", "eligible_students", "x.*")
        .drop("cooldown")
    )
    entries = [
        F.struct(
            F.lit(int(d)).alias("observation_day"),
            *[F.col(f"{c}{i}").alias(c) for c in ("opening", "new", "merged", "suppressed", "waiting", "reviewed", "delay")],
            F.col(f"a{i}").alias("alert"),
        )
        for i, d in enumerate(days)
    ]
    long = lanes.select(*SLICE, "entity", F.explode(F.array(*entries)).alias("e")).select(*SLICE, "entity", "e.*")
    by = [*SLICE, "observation_day"]
    first_review = (
        long.where("reviewed")
        .groupBy(*SLICE, "entity")
        .agg(F.min("observation_day").alias("observation_day"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("first_reviews"))
    )
    flags = {
        "raw_alerts_generated": "alert",
        "opening_backlog": "opening",
        "new_cases_opened": "new",
        "alerts_merged": "merged",
        "alerts_suppressed_by_cooldown": "suppressed",
        "queue_size_before_review": "waiting",
        "reviews_completed": "reviewed",
    }
    # delays are few: rows are counted per delay, and quartiles read those counts
    per_delay = long.groupBy(*by, "delay").agg(
        F.count(F.lit(1)).alias("rows_of"), *[F.count_if(c).alias(name) for name, c in flags.items()]
    )
    rows_of, delay = F.col("rows_of"), F.col("delay")
    counts = per_delay.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in flags],
        _day_quartiles(delay, rows_of).alias("q"),
        (F.sum(delay * rows_of) / F.sum(F.when(delay.isNotNull(), rows_of))).alias("mean_review_delay"),
        F.max(delay).alias("maximum_review_delay"),
        F.sum(F.when(delay == 0, rows_of)).alias("same_day"),
        F.sum(F.when(delay <= 14, rows_of)).alias("cases_reviewed_within_14_days"),
        F.sum(F.when(delay <= 28, rows_of)).alias("cases_reviewed_within_28_days"),
    )
    zeros = [
        "raw_alerts_generated", "opening_backlog", "new_cases_opened", "alerts_merged",
        "alerts_suppressed_by_cooldown", "queue_size_before_review", "reviews_completed", "same_day",
        "cases_reviewed_within_14_days", "cases_reviewed_within_28_days", "first_reviews",
    ]
    joined = frame.join(counts, by, "left").join(first_review, by, "left").na.fill(0, zeros)
    waiting, done = F.col("queue_size_before_review"), F.col("reviews_completed")
    raw = F.when(F.col("capacity_kind") == RATE, F.floor(F.col("eligible_students") * F.col("capacity_value"))).otherwise(
        F.col("capacity_value").cast("long")
    )
    limit = capacity_count(F.col("eligible_students"), F.col("capacity_kind"), F.col("capacity_value"))
    available = (
        F.when(F.col("capacity_kind") == UNLIMITED, waiting)
        .when((F.col("capacity_kind") == RATE) & (waiting == 0), F.greatest(raw, F.lit(0)))
        .otherwise(limit)
    )
    return joined.select(
        *SCENARIO_COLUMNS,
        *UNIT_KEYS,
        "observation_day",
        "eligible_students",
        "raw_alerts_generated",
        "opening_backlog",
        "new_cases_opened",
        "alerts_merged",
        "alerts_suppressed_by_cooldown",
        available.alias("available_review_capacity"),
        "reviews_completed",
        (done - F.col("first_reviews")).alias("repeated_reviews"),
        F.when(F.col("capacity_kind") != UNLIMITED, F.greatest(raw - done, F.lit(0))).alias("unused_capacity"),
        "queue_size_before_review",
        (waiting - done).alias("queue_size_after_review"),
        ratio(done, available).alias("capacity_utilization"),
        ratio(F.col("raw_alerts_generated"), F.col("eligible_students")).alias("alert_rate"),
        ratio(done, F.col("eligible_students")).alias("review_rate"),
        ratio(done, F.col("raw_alerts_generated")).alias("proportion_alerts_reviewed"),
        F.col("q")[1].alias("median_review_delay"),
        "mean_review_delay",
        F.col("q")[0].alias("review_delay_q1"),
        F.col("q")[2].alias("review_delay_q3"),
        "maximum_review_delay",
        ratio(F.col("same_day"), done).alias("same_checkpoint_review_proportion"),
        "cases_reviewed_within_14_days",
        "cases_reviewed_within_28_days",
    )


def balance_errors(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints where opening + new - reviewed is not the closing queue."""
    bad = (
        F.col("opening_backlog") + F.col("new_cases_opened") - F.col("reviews_completed")
        != F.col("queue_size_after_review")
    )
    return checkpoints.agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("balance_errors"))


def scenario_summary(cases: DataFrame, checkpoints: DataFrame, events: DataFrame, policies: Sequence[str]) -> DataFrame:
    """Workload, outcome and episode measures per scenario."""
    y, review = F.col("actual_label"), F.col("review_day")
    done = review.isNotNull()
    start = F.col("episode_start_day")
    lead = F.when(done & (review < start), start - review)
    q, lq = _day_quartiles(F.col("review_delay")), _day_quartiles(lead)
    case_sums = cases.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("cases_created"),
        F.count_if(done).alias("reviews_completed"),
        F.count_if(~done).alias("unresolved_cases"),
        q.alias("q"),
        F.avg("review_delay").alias("mean_review_delay"),
        F.max("review_delay").alias("maximum_review_delay"),
        F.count_if(done & (y == 1)).alias("reviewed_future_inactive_cases"),
        F.count_if(done & (y == 0)).alias("reviewed_future_active_cases"),
        F.count_if(~done & (y == 1)).alias("unreviewed_future_inactive_alerts"),
        F.count_if(~done & (y == 0)).alias("unreviewed_future_active_alerts"),
        lq.alias("lq"),
        F.min(lead).alias("minimum_useful_lead_time"),
        F.max(lead).alias("maximum_useful_lead_time"),
    )
    per_entity = cases.groupBy("scenario_id", *ENTITY_KEYS).agg(
        F.max(start).alias("s"),
        F.min(review).alias("first_review"),
    )
    episode_sums = per_entity.groupBy("scenario_id").agg(
        F.count_if(F.col("s").isNotNull() & (F.col("first_review") < F.col("s"))).alias("episodes_reviewed_before_start"),
        F.count_if(F.col("s").isNotNull() & (F.col("first_review") >= F.col("s"))).alias("episodes_reviewed_after_start"),
        F.count_if(F.col("s").isNotNull() & F.col("first_review").isNull()).alias("episodes_alerted_no_completed_review"),
        F.count_if(F.col("s").isNull() & F.col("first_review").isNotNull()).alias("no_episode_reviewed_cases"),
    )
    totals = checkpoints.groupBy(*SCENARIO_COLUMNS).agg(
        F.sum("eligible_students").alias("eligible_observations"),
        F.sum("raw_alerts_generated").alias("raw_alerts"),
        F.sum("available_review_capacity").alias("capacity"),
    )
    alert_entries = F.array(
        *[
            F.struct(F.lit(p).alias("threshold_policy"), F.col(f"{p}_prediction").alias("d"))
            for p in policies
        ]
    )
    event_sums = (
        events.select("actual_label", F.explode(alert_entries).alias("x"))
        .groupBy("x.threshold_policy")
        .agg(
            F.sum("actual_label").alias("positive_events"),
            F.sum(F.col("actual_label") * F.col("x.d")).alias("alert_positive"),
        )
    )
    episodes = (
        events.where(F.col("episode_start_day").isNotNull())
        .select(*ENTITY_KEYS)
        .distinct()
        .agg(F.count(F.lit(1)).alias("eligible_episodes"))
        .withColumn("one", F.lit(1))
    )
    joined = (
        totals.join(case_sums, "scenario_id", "left")
        .join(episode_sums, "scenario_id", "left")
        .join(event_sums, "threshold_policy", "left")
        .withColumn("one", F.lit(1))
        .join(episodes, "one")
    )
    zero = [
        "cases_created", "reviews_completed", "unresolved_cases", "reviewed_future_inactive_cases",
        "reviewed_future_active_cases", "unreviewed_future_inactive_alerts", "unreviewed_future_active_alerts",
        "episodes_reviewed_before_start", "episodes_reviewed_after_start", "episodes_alerted_no_completed_review",
        "no_episode_reviewed_cases",
    ]
    f = joined.na.fill(0, zero)
    caught, n = F.col("reviewed_future_inactive_cases"), F.col("reviews_completed")
    missed = F.col("unreviewed_future_inactive_alerts")
    before = F.col("episodes_reviewed_before_start")
    return f.select(
        *SCENARIO_COLUMNS,
        "eligible_observations",
        "raw_alerts",
        "cases_created",
        "reviews_completed",
        "unresolved_cases",
        ratio(n, F.col("capacity")).alias("capacity_utilization"),
        ratio(n, F.col("raw_alerts")).alias("proportion_alerts_reviewed"),
        F.col("q")[1].alias("median_review_delay"),
        "mean_review_delay",
        F.col("q")[0].alias("review_delay_q1"),
        F.col("q")[2].alias("review_delay_q3"),
        "maximum_review_delay",
        "reviewed_future_inactive_cases",
        "reviewed_future_active_cases",
        "unreviewed_future_inactive_alerts",
        "unreviewed_future_active_alerts",
        ratio(caught, n).alias("precision_among_reviewed"),
        ratio(caught, F.col("positive_events")).alias("fraction_all_future_inactive_reviewed"),
        ratio(caught, F.col("alert_positive")).alias("fraction_alert_positive_future_inactive_reviewed"),
        F.col("reviewed_future_active_cases").alias("false_alerts_reviewed"),
        missed.alias("true_alerts_not_reviewed_capacity"),
        (ratio(caught, n) * 100).alias("outcome_capture_per_100_reviews"),
        ratio(n, caught).alias("reviews_per_captured_future_inactive"),
        (F.col("positive_events") - F.col("alert_positive")).alias("model_misses"),
        missed.alias("capacity_misses"),
        missed.alias("horizon_misses"),
        "eligible_episodes",
        "episodes_reviewed_before_start",
        "episodes_reviewed_after_start",
        "episodes_alerted_no_completed_review",
        (
            F.col("eligible_episodes") - before - F.col("episodes_reviewed_after_start")
            - F.col("episodes_alerted_no_completed_review")
        ).alias("episodes_with_no_alert"),
        "no_episode_reviewed_cases",
        F.col("lq")[1].alias("median_useful_lead_time"),
        F.col("lq")[0].alias("useful_lead_time_q1"),
        F.col("lq")[2].alias("useful_lead_time_q3"),
        "minimum_useful_lead_time",
        "maximum_useful_lead_time",
    )


def loss_against_unlimited(summary: DataFrame) -> DataFrame:
    """Useful reviews lost against the best unlimited scenario of the policy."""
    from pyspark.sql import Window as W

    best = F.max(
        F.when(F.col("capacity_kind") == UNLIMITED, F.col("episodes_reviewed_before_start"))
    ).over(W.partitionBy("threshold_policy"))
    return summary.withColumn(
        "useful_warnings_lost_relative_to_unlimited_same_checkpoint",
        F.coalesce(best, F.lit(0)) - F.col("episodes_reviewed_before_start"),
    )


def subgroup_access(
    cases: DataFrame,
    labelled: DataFrame,
    attributes: Sequence[str],
    minimum_rows: int = 50,
    minimum_entities: int = 25,
    minimum_positives: int = 10,
) -> DataFrame:
    """Review access per scenario, attribute and group, with support rules."""
    from tidemark.operators.audit import _by_attribute, join_attributes

    long = _by_attribute(join_attributes(cases, labelled, attributes), attributes)
    by = ["scenario_id", "attribute", "group"]
    y, done = F.col("actual_label") == 1, F.col("review_day").isNotNull()
    start = F.col("episode_start_day")
    sums = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("entity").alias("unique_entities"),
        F.count_if(y).alias("positive_cases"),
        F.count_if(done).alias("reviewed"),
        F.count_if(y & done).alias("reviewed_positive"),
        F.count_if(y & ~done).alias("missed_positive"),
        # delays are whole checkpoint distances, so the exact map is tiny
        F.percentile("review_delay", 0.5).alias("median_review_delay"),
        F.count_if(start.isNotNull()).alias("with_episode"),
        F.count_if(start.isNotNull() & (F.col("review_day") < start)).alias("early"),
    )
    courses = long.groupBy(*by, *UNIT_KEYS).agg(F.avg(done.cast("double")).alias("r")).groupBy(*by).agg(
        F.avg("r").alias("equal_presentation_weighted_review_rate"),
        F.count(F.lit(1)).alias("contributing_presentations"),
    )
    n = F.col("rows")
    ok = (n >= minimum_rows) & (F.col("unique_entities") >= minimum_entities)
    outcome_ok = ok & (F.col("positive_cases") >= minimum_positives)
    rate = ratio(F.col("reviewed"), n)
    return sums.join(courses, by).select(
        *by,
        "rows",
        "unique_entities",
        "positive_cases",
        ok.alias("supported"),
        F.when(~ok, F.lit("minimum_rows_or_students")).alias("suppression_reason"),
        F.lit(1.0).alias("alert_rate"),
        rate.alias("review_rate"),
        rate.alias("proportion_alerts_reviewed"),
        "equal_presentation_weighted_review_rate",
        rate.alias("row_count_weighted_review_rate"),
        "contributing_presentations",
        "median_review_delay",
        ratio(n - F.col("reviewed"), n).alias("unresolved_at_horizon_rate"),
        F.when(outcome_ok, ratio(F.col("missed_positive"), F.col("positive_cases"))).alias("capacity_miss_rate_future_inactive"),
        F.when(ok, ratio(F.col("reviewed_positive"), F.col("reviewed"))).alias("precision_among_reviewed"),
        F.when(outcome_ok, ratio(F.col("early"), F.col("with_episode"))).alias("episode_before_start_review_rate"),
    )
