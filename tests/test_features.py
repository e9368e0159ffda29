"""Daily, rolling, baseline, outcome and assembly facts on tiny inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.baseline import personal_baseline
from tidemark.operators.daily import daily_activity, daily_statistics, unmatched_resources, with_activity_type
from tidemark.operators.modeling import assemble, excluded, included
from tidemark.operators.outcomes import future_inactivity
from tidemark.operators.rolling import rolling_features
from tidemark.schema import DAILY_COLUMNS

LOG = "unit string, period string, entity long, day int, resource long, clicks long, activity_type string"


def events(spark, rows):
    return spark.createDataFrame(rows, LOG)


def one(spark, days):
    """Events of a single entity: {day: (clicks, resources)}."""
    rows = []
    for day, (clicks, resources) in days.items():
        for i, r in enumerate(resources):
            rows.append(("A", "P", 1, day, r, clicks if i == 0 else 0, "homepage"))
    return events(spark, rows)


def series(df, column):
    return [r[column] for r in df.orderBy("unit", "period", "entity", "day").collect()]


def test_daily_categories_and_unmatched(spark):
    log = spark.createDataFrame(
        [("A", "P", 1, 3, s, c) for s, c in [(1, 5), (2, 4), (3, 5), (4, 6), (5, 7), (5, 0)]]
        + [("A", "P", 2, 3, 99, 8), ("A", "Q", 2, 3, 1, 9), ("B", "P", 2, 3, 1, 10)],
        "unit string, period string, entity long, day int, resource long, clicks long",
    )
    kinds = ["homepage", "forumng", "oucontent", "quiz", "externalquiz"]
    lookup = spark.createDataFrame(
        [("A", "P", i + 1, k) for i, k in enumerate(kinds)] + [("A", "Q", 1, "homepage"), ("B", "P", 1, "quiz")],
        "unit string, period string, resource long, activity_type string",
    )
    daily = daily_activity(with_activity_type(log, lookup))
    assert daily.columns == DAILY_COLUMNS
    rows = {(r.unit, r.period, r.entity): r for r in daily.collect()}
    first = rows[("A", "P", 1)]
    assert len(rows) == 4
    assert (first.homepage_clicks, first.forum_clicks, first.content_clicks, first.quiz_clicks) == (5, 4, 5, 13)
    assert (first.number_of_resources_visited, first.number_of_activity_types_used) == (5, 5)
    assert rows[("A", "P", 2)].activity_types == ["unknown"]
    assert unmatched_resources(log, lookup).first().unmatched_site_ids == 1
    assert daily_statistics(daily).first().total_clicks == 54


def test_rolling_known_series(spark):
    daily = daily_activity(one(spark, {1: (5, [10, 11]), 3: (7, [10]), 10: (2, [12])}))
    rolled = rolling_features(daily)
    assert series(rolled, "clicks_last_7_days") == [5, 5, 12, 12, 12, 12, 12, 7, 7, 2]
    assert series(rolled, "active_days_last_7_days") == [1, 1, 2, 2, 2, 2, 2, 1, 1, 1]
    assert series(rolled, "resources_last_7_days") == [2, 2, 2, 2, 2, 2, 2, 1, 1, 1]
    assert series(rolled, "days_since_last_activity") == [0, 1, 0, 1, 2, 3, 4, 5, 6, 0]
    assert series(rolled, "window_complete") == [False] * 6 + [True] * 4


def test_rolling_bounds(spark):
    daily = daily_activity(one(spark, {3: (100, [1]), 4: (4, [1]), 10: (10, [1])}))
    last = rolling_features(daily, 10, 10).collect()
    assert [(r.day, r.clicks_last_7_days, r.active_days_last_7_days) for r in last] == [(10, 14, 2)]
    late = rolling_features(daily, 0, 2).collect()
    assert [r.days_since_last_activity for r in late] == [None] * 3
    assert all(r.active_days_last_7_days == 0 for r in late)
    assert rolling_features(daily, None, 2).count() == 0
    stretched = rolling_features(daily, 8, 20).orderBy("day").collect()
    assert [r.day for r in stretched] == list(range(8, 21))
    assert stretched[0].days_since_last_activity == 4
    with pytest.raises(ValueError):
        rolling_features(daily, 5, 4)


def test_rolling_against_brute_force(spark):
    rng = random.Random(7)
    rows, active = [], {}
    for entity in range(1, 9):
        for _ in range(rng.randint(1, 25)):
            day, resource = rng.randint(-5, 25), rng.randint(1, 6)
            kind = rng.choice(["homepage", "quiz", "other"])
            rows.append(("A", "P", entity, day, resource, rng.randint(0, 4), kind))
    for u, p, e, d, r, c, k in rows:
        active.setdefault(e, []).append((d, r, c, k))
    got = {(r.entity, r.day): r for r in rolling_features(daily_activity(events(spark, rows)), 0, 20).collect()}
    assert len(got) == 8 * 21
    for entity, items in active.items():
        for day in range(21):
            window = [x for x in items if day - 6 <= x[0] <= day]
            past = [x[0] for x in items if x[0] <= day]
            row = got[(entity, day)]
            assert row.clicks_last_7_days == sum(x[2] for x in window)
            assert row.active_days_last_7_days == len({x[0] for x in window})
            assert row.resources_last_7_days == len({x[1] for x in window})
            assert row.activity_types_last_7_days == len({x[3] for x in window})
            assert row.days_since_last_activity == (day - max(past) if past else None)


def test_appending_later_days_changes_nothing_earlier(spark):
    base = {1: (5, [1]), 4: (7, [2]), 9: (2, [3])}
    early = rolling_features(daily_activity(one(spark, base)), 0, 9)
    later = rolling_features(daily_activity(one(spark, {**base, 12: (50, [9]), 15: (1, [1])})), 0, 15)
    a = personal_baseline(early, 2).orderBy("day").collect()
    b = personal_baseline(later, 2).where("day <= 9").orderBy("day").collect()
    assert a == b


def rolling_row(day, clicks, complete=True, gap=0):
    return ("A", "P", 1, day, complete, clicks, 1, gap)


ROLLING = (
    "unit string, period string, entity long, day int, window_complete boolean, clicks_last_7_days long, "
    "active_days_last_7_days long, days_since_last_activity long"
)


def test_baseline_hand_example(spark):
    rows = spark.createDataFrame([rolling_row(d, c) for d, c in zip((1, 2, 3, 4), (10, 20, 30, 0))], ROLLING)
    out = personal_baseline(rows, 3).orderBy("day").collect()
    assert [r.historical_windows_available for r in out] == [0, 1, 2, 3]
    assert [r.historical_average_clicks for r in out] == [None, 10, 15, 20]
    assert out[1].historical_standard_deviation_clicks is None
    assert out[2].historical_standard_deviation_clicks == pytest.approx(7.0710678)
    assert [r.click_percentage_change_from_personal_average for r in out] == [None, 100, 100, -100]
    assert out[3].click_z_score == pytest.approx(-2)
    assert [r.baseline_ready for r in out] == [False, False, False, True]


def test_baseline_null_rules(spark):
    flat = spark.createDataFrame([rolling_row(d, 0) for d in (1, 2, 3)], ROLLING)
    last = personal_baseline(flat, 0).orderBy("day").collect()[-1]
    assert last.historical_standard_deviation_clicks == 0 and last.click_z_score is None
    assert last.click_percentage_change_from_personal_average is None and last.baseline_ready
    partial = spark.createDataFrame([rolling_row(1, 9, False, 5), rolling_row(2, 9, False, 6), rolling_row(3, 1, True, 0)], ROLLING)
    row = personal_baseline(partial).orderBy("day").collect()[-1]
    assert row.historical_windows_available == 0 and row.longest_previous_inactivity_gap == 6


def labels(spark, active_days, day=10, length=100, withdrawal=None, horizon=14):
    ev = events(spark, [("A", "P", 1, d, 1, 3, "quiz") for d in active_days])
    roster = spark.createDataFrame([("A", "P", 1)], "unit string, period string, entity long")
    lengths = spark.createDataFrame([("A", "P", length)] if length else [("Z", "P", 9)], "unit string, period string, length_days int")
    gone = spark.createDataFrame([("A", "P", 1, withdrawal)], "unit string, period string, entity long, withdrawal_day int")
    return future_inactivity(daily_activity(ev), roster, [day], lengths, gone, horizon).first()


def test_future_window_edges(spark):
    assert labels(spark, [10]).future_inactivity
    assert not labels(spark, [11]).future_inactivity
    assert not labels(spark, [24]).future_inactivity
    assert labels(spark, [25]).future_inactivity
    late = labels(spark, [1], day=254, length=268)
    assert labels(spark, [1], day=253, length=268).outcome_eligible and not late.outcome_eligible
    assert late.future_inactivity is None and late.future_clicks is None
    assert late.ineligibility_reason == "future_window_exceeds_course_end"
    assert labels(spark, [1], length=None).ineligibility_reason == "missing_course_metadata"


def test_withdrawal_edges(spark):
    now = labels(spark, [11], withdrawal=10)
    assert not now.prediction_eligible and now.outcome_eligible
    assert now.prediction_ineligibility_reason == "already_withdrawn_by_observation_day"
    assert labels(spark, [11], withdrawal=11).prediction_eligible
    assert labels(spark, [11], withdrawal=24).officially_withdrawn_by_window_end
    assert not labels(spark, [11], withdrawal=25).officially_withdrawn_by_window_end


def test_assembly_reasons(spark):
    ev = events(
        spark,
        [("A", "P", 1, d, 1, 3, "quiz") for d in range(0, 40, 2)] + [("A", "P", 2, d, 1, 3, "quiz") for d in range(0, 40, 3)],
    )
    roster = spark.createDataFrame([("A", "P", i) for i in (1, 2, 3)], "unit string, period string, entity long")
    lengths = spark.createDataFrame([("A", "P", 60)], "unit string, period string, length_days int")
    gone = spark.createDataFrame([("A", "P", 2, 20)], "unit string, period string, entity long, withdrawal_day int")
    daily = daily_activity(ev)
    features = personal_baseline(rolling_features(daily, 0, 50), 7)
    days = [3, 8, 28, 50]
    table = assemble(future_inactivity(daily, roster, days, lengths, gone, 14), features, None, days)
    reason = {(r.entity, r.observation_day): r.exclusion_reasons for r in table.collect()}
    assert reason[(1, 28)] is None
    assert reason[(1, 3)] == "partial_rolling_window|baseline_not_ready"
    assert reason[(1, 8)] == "baseline_not_ready"
    assert reason[(1, 50)] == "future_window_exceeds_course_end|missing_target"
    assert reason[(2, 28)] == "already_withdrawn_by_observation_day|withdrawn_by_observation_day"
    assert reason[(3, 28)] == "missing_rolling_features|missing_personal_baseline"
    assert included(table).count() + excluded(table).count() == 12
    with pytest.raises(ValueError):
        future_inactivity(daily, roster, [3, 3], lengths)


def test_one_hot_entity_keeps_totals(spark):
    """A third of all rows on one entity and day still gives one exact row."""
    hot = spark.range(3000).select(
        F.lit("A").alias("unit"), F.lit("P").alias("period"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("entity"),
        F.lit(4).alias("day"), (F.col("id") % 50).alias("resource"), F.lit(1).cast("long").alias("clicks"),
        F.lit("quiz").alias("activity_type"),
    )
    row = daily_activity(hot).where("entity = 0").first()
    assert row.total_clicks == 1000 and row.number_of_resources_visited == 50


def test_rolling_rows_are_not_multiplied_by_their_items(spark):
    """Items seen again after 6, 7 and 8 days; the only rows added are calendar days."""
    from itertools import chain

    from tidemark.operators.rolling import rolling_features

    seen = {0: [1, 2, 3], 6: [1], 7: [2, 9], 8: [3, 9], 15: [1]}
    rows = [("U", "P", 1, d, 1, 0, 0, 0, 0, r, ["t"]) for d, r in seen.items()]
    daily = spark.createDataFrame(
        rows,
        "unit string, period string, entity long, day int, total_clicks long, homepage_clicks long, forum_clicks long,"
        " content_clicks long, quiz_clicks long, resource_ids array<long>, activity_types array<string>",
    )
    out = rolling_features(daily, 0, 20)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    got = {r.day: (r.resources_last_7_days, r.activity_types_last_7_days) for r in out.collect()}
    for d in range(21):
        near = [r for t, r in seen.items() if d - 6 <= t <= d]
        assert got[d] == (len(set(chain(*near))), int(bool(near)))
