"""Trajectories, episodes, audit, review, sources, streams and models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit as Au
from tidemark.operators import models as Mo
from tidemark.operators import review as R
from tidemark.operators import trajectories as Tr
from tidemark.operators.drift import population_stability
from tidemark.operators.holdout import fold_classes, grouped_folds
from tidemark.plans.jobs import build_daily_table
from tidemark.session import scratch_folder
from tidemark.sources import tables as T
from tidemark.streaming import core as C
from tidemark.streaming import stateful as St

DAYS = (14, 28, 42, 56)
PRED = "unit string, period string, entity long, observation_day int, calibrated_output double, actual_label int, f1_focused_prediction int"


def all_sequences(spark):
    rows = []
    for e, bits in enumerate(itertools.product("01", repeat=4)):
        for d, b in zip(DAYS, bits):
            rows.append(("A", "P", e, d, 0.9 if b == "1" else 0.1, int(b), int(b)))
    return spark.createDataFrame(rows, PRED)


def test_all_sequences(spark):
    table = Tr.trajectory_table(all_sequences(spark), DAYS, "f1_focused_prediction")
    rows = {r.warning_sequence: r for r in table.collect()}
    assert len(rows) == 16
    known = {
        "0000": "Never warned", "0111": "Persistent warning", "1000": "Temporary warning",
        "1010": "Recurrent warning", "0001": "First warned Day 56", "1011": "Recurrent warning",
    }
    for bits, name in known.items():
        assert rows[bits].primary_category == name
    assert rows["0111"].longest_warning_run == 3 and rows["0111"].first_warning_day == 28
    assert rows["1010"].alternating_warning and rows["1010"].warning_reversals == 3
    assert rows["1011"].persistent_warning and not rows["0001"].persistent_warning
    states = {(r.warning_sequence, r.observation_day, r.strategy): r.decision for r in Tr.strategy_decisions(table, DAYS, ["warning_sequence"]).collect()}
    for bits in rows:
        for i, d in enumerate(DAYS):
            assert states[(bits, d, "single")] == int(bits[i])
            if i >= 1:
                assert states[(bits, d, "two_consecutive")] == int(bits[i - 1 : i + 1] == "11")
            if i >= 2:
                assert states[(bits, d, "two_of_three")] == int(bits[i - 2 : i + 1].count("1") >= 2)
    assert states[("0001", 56, "persistent_or_late")] == 1
    assert ("1100", 14, "persistent_or_late") not in states
    with pytest.raises(ValueError):
        Tr.strategy_state(F.lit("1100"), 0, "persistent_or_late", 3)


def test_episodes_against_brute_force(spark):
    rng = random.Random(2)
    active = {e: sorted(rng.sample(range(0, 70), rng.randint(0, 12))) for e in range(60)}
    active[0] = [15, 16, 31]
    daily = spark.createDataFrame(
        [("A", "P", e, d) for e, ds in active.items() for d in ds], "unit string, period string, entity long, day int"
    )
    people = spark.createDataFrame([("A", "P", e) for e in active] + [("S", "P", 1)], "unit string, period string, entity long")
    lengths = spark.createDataFrame([("A", "P", 61), ("S", "P", 21)], "unit string, period string, length_days int")
    got = {(r.unit, r.entity): r for r in Tr.inactivity_episodes(daily, people, lengths).collect()}
    for e, ds in active.items():
        want = next((s for s in range(15, 60 - 14 + 2) if not any(s <= d < s + 14 for d in ds)), None)
        assert got[("A", e)].episode_start_day == want
    assert got[("A", 0)].episode_start_day == 17
    assert not got[("S", 1)].episode_eligible


def test_group_metrics_and_disparities(spark):
    cells = [(1, 1, 0.8), (1, 0, 0.3), (0, 1, 0.6), (0, 0, 0.1)]
    rows = [("A", "P", i, 28, s, y, d, g) for g, n in (("F", 40), ("M", 20), ("X", 1)) for i, (y, d, s) in enumerate(cells * n)]
    df = spark.createDataFrame(rows, "unit string, period string, entity long, observation_day int, calibrated_output double, actual_label int, f1_focused_prediction int, gender string")
    metrics = Au.group_metrics(df, ["gender"], ["f1_focused"])
    by = {r.group: r for r in metrics.collect()}
    assert by["F"].recall == 0.5 and by["F"].false_positive_rate == 0.5
    assert by["F"].brier_score == pytest.approx(0.225) and by["F"].expected_calibration_error == pytest.approx(0.4)
    assert by["X"].recall is None and by["X"].reason_recall.startswith("rows<50;students<25;positives<10")
    gaps = Au.disparities(metrics).where("analysis_type = 'group_minus_reference' AND metric = 'recall'").collect()
    assert {(r.group, r.reference_group, r.value) for r in gaps} == {("F", "F", 0.0), ("M", "F", 0.0), ("X", "F", None)}


EVENT = PRED + ", current_inactivity_gap int, episode_start_day int"


def alerts(spark, people, days=DAYS, flip=False):
    rows = [("A", "P", e, d, 0.9 - e / 100, int((e + d) % 2 == 0) ^ flip, 1, e % 5, None) for e in people for d in days]
    return spark.createDataFrame(rows, EVENT)


def test_review_rules(spark):
    one = alerts(spark, [1])
    make = lambda kind, value, rule, p="highest_score": R.Scenario("f1_focused", kind, value, rule, p)
    scenarios = [make(R.UNLIMITED, None, "cooldown_14"), make(R.UNLIMITED, None, "cooldown_28"), make(R.UNLIMITED, None, R.OPEN_CASE), make(R.UNLIMITED, None, R.EVERY_ALERT)]
    cases = R.review_cases(R.allocate_reviews(one, scenarios, DAYS))
    counts = {r.deduplication_scenario: r["count"] for r in cases.groupBy("deduplication_scenario").count().collect()}
    assert counts == {"cooldown_14": 4, "cooldown_28": 2, "open_case": 1, "every_alert": 4}
    lanes = R.allocate_reviews(alerts(spark, [1, 2]), [make(R.FIXED, 0.0, R.OPEN_CASE)], DAYS)
    held = R.review_cases(lanes).collect()
    assert len(held) == 2 and all(r.alerting_checkpoints == 4 and r.resolution_status == "unresolved_at_horizon" for r in held)
    assert all(r.consecutive_alert_count == 4 and r.most_recent_alert_day == 56 for r in held)


def test_review_ignores_labels(spark):
    scenario = [R.Scenario("f1_focused", R.RATE, 0.2, R.OPEN_CASE, p) for p in R.PRIORITIES]
    keep = ["scenario_id", "entity", "alert_origin_day", "review_day"]
    a = R.review_cases(R.allocate_reviews(alerts(spark, range(12)), scenario, DAYS)).select(keep)
    b = R.review_cases(R.allocate_reviews(alerts(spark, range(12), flip=True), scenario, DAYS)).select(keep)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_capacity_floor_and_minimum(spark):
    df = spark.createDataFrame([(10, 0.05), (100, 0.2), (10, 0.0), (0, 0.5)], "n int, v double")
    assert [r[0] for r in df.select(R.capacity_count(F.col("n"), F.lit(R.RATE), F.col("v"))).collect()] == [1, 20, 0, 0]


def test_csv_bom_nulls_and_negative_clicks(spark, tmp_path):
    reg = tmp_path / "reg.csv"
    reg.write_bytes("﻿code_module,code_presentation,id_student,date_registration,date_unregistration\nA,P,1,-5,?\nA,P,2,?,30\n".encode())
    got = {r.entity: r.withdrawal_day for r in T.read_withdrawals(spark, str(reg)).collect()}
    assert got == {1: None, 2: 30}
    log = spark.createDataFrame([("A", "P", 1, 1, 7, -2)], "unit string, period string, entity long, day int, resource long, clicks long")
    lookup = spark.createDataFrame([("A", "P", 7, "quiz")], "unit string, period string, resource long, activity_type string")
    with pytest.raises(Exception):
        build_daily_table(log, lookup, scratch_folder(spark, "bad"))


def test_scan_prunes_and_pushes(spark):
    from checks import adapter as A

    root = scratch_folder(spark, "pruned")
    T.write_daily(A.daily(spark, "/root/testdata/sf0.001"), root)
    plan = T.read_daily(spark, root, unit="M1", entity=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(unit" in plan and "EqualTo(entity,3)" in plan


def test_features_use_one_exchange_by_entity(spark):
    from checks import adapter as A
    from tidemark.operators.baseline import personal_baseline
    from tidemark.operators.rolling import rolling_features

    root = scratch_folder(spark, "daily")
    T.write_daily(A.daily(spark, "/root/testdata/sf0.001"), root)
    out = personal_baseline(rolling_features(spark.read.parquet(root), 0, 19))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan


def test_folds_never_share_entities(spark):
    rows = spark.createDataFrame([(e, d, int((e + d) % 4 == 0)) for e in range(40) for d in range(3)], "entity long, observation_day int, y int")
    folds, count, reason = grouped_folds(rows, "y", 5)
    assert count == 5 and reason is None
    assert folds.select("entity").distinct().count() == folds.count() == 40
    assert sum(r.validation_rows for r in fold_classes(rows, folds, "y").collect()) == 120


def test_model_reproduces_contributions_and_calibrates(spark):
    from tidemark.operators.explain import contributions
    from tidemark.schema import CHANGE_FEATURES

    rng = random.Random(4)
    rows = []
    for e in range(120):
        y = e % 2
        vals = [rng.gauss(y, 1) for _ in CHANGE_FEATURES]
        vals[5] = None if e % 7 == 0 else vals[5]
        rows.append((e, y, *map(lambda v: None if v is None else float(v), vals)))
    df = spark.createDataFrame(rows, "entity long, y int, " + ", ".join(f"{c} double" for c in CHANGE_FEATURES))
    model = Mo.fit_base_model(df, CHANGE_FEATURES, "y")
    assert "missing_indicator__click_z_score" in model.names and len(model.names) == 11
    explained = contributions(model, df, ["entity"])
    assert explained.where("NOT contribution_sum_verified").count() == 0
    scored = Mo.apply_base_model(model, df, "p")
    iso = Mo.fit_calibrator("isotonic", scored, "p", "y").apply(scored, "p")
    assert iso.agg(F.min("calibrated_output"), F.max("calibrated_output")).first() == (0.0, 1.0)
    folds, count, _ = grouped_folds(df, "y", 3)
    oof, _ = Mo.out_of_fold_scores(df, folds, count, CHANGE_FEATURES, "y")
    assert oof.count() == oof.select("entity").distinct().count() == 120


def test_psi_of_equal_histograms(spark):
    h = spark.createDataFrame([([3, 1, 0, 6],)], "histogram array<long>")
    assert population_stability(h, h).first().psi == 0


def test_scoring_refuses_overwrite(spark):
    path = scratch_folder(spark, "scores")
    df = spark.createDataFrame([(0.5,)], "score double")
    T.write_scores(df, path)
    with pytest.raises(Exception):
        T.write_scores(df, path)
    T.write_scores(df, path, replace=True)


STREAM = "unit string, period string, entity long, event_time timestamp, resource long, clicks long, activity_type string"


def write_files(spark, name, batches):
    """One file per batch, in arrival order."""
    folder = scratch_folder(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_late_rows_are_dropped_and_days_close(spark):
    import datetime as dt

    at = lambda d, h=1: dt.datetime(2024, 1, d, h)
    ev = lambda e, t, c: ("A", "P", e, t, 1, c, "quiz")
    folder = write_files(
        spark, "late", [[ev(1, at(1), 5), ev(1, at(1, 3), 2)], [ev(1, at(4), 7)], [ev(1, at(6), 1)], [ev(1, at(1, 5), 100)], [ev(2, at(9), 1)]]
    )
    schema = spark.read.parquet(folder).schema
    out = C.drain(C.stream_daily(C.replay_source(spark, folder, schema), "2024-01-01"), "late-out")
    assert {(r.entity, r.day): r.total_clicks for r in out.collect()} == {(1, 0): 7, (1, 3): 7, (1, 5): 1}


def test_online_baseline_over_many_batches(spark):
    from checks import adapter as A
    from tidemark.operators.baseline import personal_baseline

    sf = "/root/testdata/sf0.001"
    rolled = A.rolling(spark, sf).where("unit = 'M0'").cache()
    folder = scratch_folder(spark, "days")
    for low, high in ((0, 6), (7, 12), (13, 19), (20, 29)):
        rolled.where(F.col("day").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
    got = C.drain(St.online_baseline(C.replay_source(spark, folder, rolled.schema)), "online")
    want = personal_baseline(rolled).select(*got.columns)
    diff = got.alias("g").join(want.alias("w"), ["unit", "period", "entity", "day"])
    bad = diff.where(
        "g.historical_windows_available <> w.historical_windows_available OR NOT g.longest_previous_inactivity_gap <=> w.longest_previous_inactivity_gap "
        "OR abs(g.historical_average_clicks - w.historical_average_clicks) > 1e-9 OR abs(g.historical_standard_deviation_clicks - w.historical_standard_deviation_clicks) > 1e-9"
    )
    assert got.count() == want.count() == diff.count() and bad.count() == 0


def test_online_baseline_shares_states_between_neighbours(spark):
    """200 entities need four calls and states in place of 200; negative ids and new entities keep their own history."""
    from tidemark.operators.baseline import personal_baseline

    rolled = spark.range(-50, 150).selectExpr("'U' AS unit", "'P' AS period", "id AS entity").crossJoin(spark.range(9).selectExpr("CAST(id AS int) AS day")).selectExpr(
        "*", "day >= 2 AS window_complete", "pmod(entity * 7 + day * day, 11) AS clicks_last_7_days", "pmod(entity + day, 5) AS active_days_last_7_days",
        "CASE WHEN day > pmod(entity, 4) THEN pmod(entity * day, 6) END AS days_since_last_activity",
    ).where("day >= 4 OR entity % 3 = 0").cache()
    folder = scratch_folder(spark, "neighbours")
    for low, high in ((0, 3), (4, 8)):
        rolled.where(F.col("day").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
    out = scratch_folder(spark, "neighbours-out")
    stream = St.online_baseline(C.replay_source(spark, folder, rolled.schema))
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 4
    got = spark.read.schema(stream.schema).parquet(f"{out}/data")
    want = personal_baseline(rolled).select(*got.columns)
    rounded = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert rounded(got) == rounded(want)


def test_first_alert_within_watermark(spark):
    import datetime as dt

    ev = lambda e, d: ("A", "P", e, dt.datetime(2024, 1, d), 1, 1, "quiz")
    folder = write_files(spark, "dups", [[ev(1, 1)], [ev(1, 3), ev(2, 3)], [ev(3, 31)], [ev(4, 31)], [ev(1, 31)]])
    out = C.drain(C.first_alerts(C.replay_source(spark, folder, spark.read.parquet(folder).schema)), "dups-out")
    assert sorted((r.entity, r.event_time.day) for r in out.collect()) == [(1, 1), (1, 31), (2, 3), (3, 31), (4, 31)]


def test_importance_of_all_folds_is_no_single_plan(spark):
    """Each fold's importance is computed on its own; the summary only reads the results."""
    from tidemark.plans.experiments import explainability_experiment
    from tidemark.schema import CHANGE_FEATURES

    rows = spark.range(240).selectExpr(
        "id AS entity", "'U' AS unit", "'P' AS period", "10 AS observation_day", "CAST(id % 3 = 0 AS int) AS quiet",
        *[f"CAST((id * {k + 7}) % 11 + id % 3 AS double) AS {c}" for k, c in enumerate(CHANGE_FEATURES)],
    )
    out = explainability_experiment(rows, "quiet", [10], folds=2, repeats=1)["importance_summary"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Window" not in plan
    got = out.collect()
    assert {r.feature for r in got} == set(CHANGE_FEATURES) and {r.folds_present for r in got} == {2}


def test_reviewed_cases_need_no_shuffle_of_lanes(spark):
    """One last place per slice decides who is reviewed; lanes stay columns of written files."""
    scenarios = [
        R.Scenario("f1_focused", kind, value, R.OPEN_CASE, p)
        for p in R.PRIORITIES
        for kind, value in ((R.FIXED, 3.0), (R.FIXED, 40.0), (R.RATE, 0.5), (R.UNLIMITED, None))
    ]
    lanes = R.allocate_reviews(alerts(spark, range(12)), scenarios, DAYS)
    done = lanes.where("reviewed0").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.max("entity").alias("last"))
    got = {r["scenario_id"]: (r["n"], r["last"]) for r in done.collect()}
    want = {s.name: {3.0: (3, 2), 0.5: (6, 5)}.get(s.capacity_value, (12, 11)) for s in scenarios}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[s.name] == want[s.name] for s in scenarios if s.priority != "inactivity_gap" and s.priority != "hybrid")
    plan = lanes._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "hashpartitioning" not in plan
