"""Metrics, quantiles, rankings and thresholds against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import ranking as Rk
from tidemark.functions import scalars as S
from tidemark.operators import metrics as X
from tidemark.operators import shift as Sh
from tidemark.operators import thresholds as Th
from tidemark.operators.trajectories import weighted_median


def scored(spark, labels, scores, day=1):
    return spark.createDataFrame([(day, int(y), float(s)) for y, s in zip(labels, scores)], "d int, y int, s double")


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)


def brute_ap(labels, scores):
    total = sum(labels)
    if not total:
        return None
    ap = hits = seen = 0
    for s in sorted(set(scores), reverse=True):
        here = [y for y, v in zip(labels, scores) if v == s]
        hits, seen = hits + sum(here), seen + len(here)
        ap += sum(here) / total * hits / seen
    return ap


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=1, max_size=40))
def test_ranking_matches_brute_force(spark, pairs):
    labels, scores = [y for y, _ in pairs], [v / 8 for _, v in pairs]
    row = X.ranking_metrics(scored(spark, labels, scores), ["d"], "s", "y").first()
    for got, want in ((row.roc_auc, brute_auc(labels, scores)), (row.average_precision, brute_ap(labels, scores))):
        assert (got is None and want is None) or got == pytest.approx(want)
    assert row.true_positives + row.false_positives + row.false_negatives + row.true_negatives == len(labels)


def test_known_calibration(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    report = X.calibration_report(df, ["d"], "s", "y").first()
    assert report.brier_score == pytest.approx(0.025)
    assert report.expected_calibration_error == pytest.approx(0.15)
    bins = X.calibration_bins(scored(spark, [0, 1], [0.0, 1.0]), ["d"], "s", "y").orderBy("bin_lower").collect()
    assert [b.row_count for b in bins] == [1] + [0] * 8 + [1]
    assert bins[4].mean_predicted_value is None


def test_one_class_report(spark):
    row = X.classification_report(scored(spark, [0, 0], [0.2, 0.7]), ["d"], "s", "y").first()
    assert row.recall is None and row.roc_auc is None and row.balanced_accuracy is None
    assert row.precision == 0 and row.specificity == 0.5


def test_threshold_policies(spark):
    df = scored(spark, [0, 0, 1, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.8, 0.9])
    picked = {r.threshold_policy: r for r in Th.select_thresholds(df, ["d"], "s", "y", 0.5, 0.8, 0.34, 5, 1).collect()}
    assert picked["recall_focused"].threshold == 0.3
    assert picked["f1_focused"].threshold == 0.3 and picked["f1_focused"].f1 == pytest.approx(6 / 7)
    assert picked["alert_capacity"].threshold == 0.8
    assert picked["cost_sensitive"].threshold == 0.3
    assert picked["fixed"].threshold == 0.5 and picked["fixed"].true_positives == 2
    ends = [r.threshold for r in Th.threshold_candidates(scored(spark, [0, 1], [0.2, 0.8]), ["d"], "s", "y").orderBy(F.desc("threshold")).collect()]
    assert ends == [1.0000000000000002, 0.8, 0.2, 0.0]


def test_quantiles_match_numpy_with_hot_slice(spark):
    rng = random.Random(3)
    rows = [(0, round(rng.gauss(0, 50), 2)) for _ in range(600)] + [(0, 7.0)] * 300
    rows += [(g, rng.choice([None, rng.random()])) for g in (1, 2, 3) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.quantiles for r in Rk.exact_quantiles(df, ["g"], "v", (0.0, 0.025, 0.25, 0.5, 0.9, 1.0)).collect()}
    for g in range(4):
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(list(np.quantile(values, (0.0, 0.025, 0.25, 0.5, 0.9, 1.0))))


@pytest.mark.parametrize("low, width", [(0.0, 1e-3), (1e6, 1e-3), (-5.0, 1e-9)])
def test_narrow_ranges_fall_into_many_cells(spark, low, width):
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.lit(low) + F.col("id") * (width / n)).alias("v"))
    rows = df.unionByName(spark.range(9 * n).select(F.lit(1).alias("g"), F.lit(low).alias("v")))
    sizes = Rk.value_cells(df.distinct(), ["g"], "v").groupBy("cell").count()
    assert sizes.agg(F.max("count")).first()[0] < n / 6
    cells = Rk.value_cells(df.distinct(), ["g"], "v").groupBy("cell").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    spans = [(r.a, r.b) for r in cells.orderBy("cell").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    values = np.array([low + i * (width / n) for i in range(n)] + [low] * (9 * n))
    got = Rk.exact_quantiles(rows, ["g"], "v", (0.5, 0.93, 0.999)).first().quantiles
    assert got == pytest.approx(list(np.quantile(values, (0.5, 0.93, 0.999))), rel=1e-15)


def test_top_k_with_ties_and_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", i, 0.5) for i in range(200)] + [("hot", 200 + i, rng.random()) for i in range(200)]
    rows += [("cold", i, round(rng.random(), 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, e int, s double").withColumn("k", F.when(F.col("g") == "hot", 170).otherwise(7))
    out = Rk.top_k(df, ["g"], "k", F.lit(5000) - Rk.score_cell(F.col("s")), [F.col("s").desc(), F.col("e")], "e", F.lit(True))
    got = {(r.g, r.e) for r in out.where("selected").collect()}
    want = set()
    for g, k in (("hot", 170), ("cold", 7)):
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want |= {(r[0], r[1]) for r in ranked[:k]}
    assert got == want and out.count() == len(rows)


def test_ranks_and_weighted_median(spark):
    values = [3.0, 1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = {r.v: r.p for r in Rk.percentile_rank(df, ["g"], "v", "p").collect()}
    assert got == {1.0: 0.0, 2.0: 0.375, 3.0: 0.75, 5.0: 1.0}
    w = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (1, 9.0, 2)], "g int, v double, w int")
    assert weighted_median(w, ["g"], "v", "w").first()["median"] == 2.0


def test_complement_quantiles_in_shift(spark):
    rng = random.Random(11)
    rows = [(1, f"h{rng.randint(0, 3)}", rng.randint(1, 40), rng.randint(0, 1), rng.choice([None, rng.random() * 100])) for _ in range(300)]
    df = spark.createDataFrame(rows, "observation_day int, holdout string, entity int, y int, f double")
    for strict in (True, False):
        for r in Sh.dataset_shift(df, ["f"], "y", "holdout", strict).collect():
            seen = {x[2] for x in rows if x[1] == r.holdout}
            train = [x for x in rows if x[1] != r.holdout and not (strict and x[2] in seen)]
            values = [x[4] for x in train if x[4] is not None]
            if train:
                assert r.training_missing_rate == pytest.approx(1 - len(values) / len(train))
            if values:
                assert r.training_median == pytest.approx(np.median(values))
                assert r.training_iqr == pytest.approx(np.subtract(*np.quantile(values, (0.75, 0.25))))


def test_bands_and_targets(spark):
    df = spark.createDataFrame([("60",), ("90",), ("121",), ("?",), (" ",)], "v string")
    bounds = F.array(F.lit(60.0), F.lit(120.0))
    assert [r[0] for r in df.select(S.credit_band(F.col("v"), bounds)).collect()] == [
        "credits <= 60", "60 < credits <= 120", "credits > 120", "Unknown / Not recorded", "Unknown / Not recorded",
    ]
    tries = spark.createDataFrame([("0",), ("1",), ("2",), ("?",)], "v string")
    assert [r[0] for r in tries.select(S.attempts_band(F.col("v"))).collect()] == ["0", "1", "2 or more", "Unknown / Not recorded"]
    with pytest.raises(Exception):
        spark.createDataFrame([("-1",)], "v string").select(S.attempts_band(F.col("v"))).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([("maybe",)], "v string").select(S.binary_target(F.col("v"))).collect()
