"""Bootstrap weights, weighted sums and ranking samples against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B

SAMPLES = 30


def weight(keys, sample, seed=42):
    x = int(hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()[:8], 16)
    x = (x + (sample + 1) * B.STEP) % 2**32
    x ^= x >> 16
    x = x * B.MULTIPLY[0] % 2**32
    x ^= x >> 15
    x = x * B.MULTIPLY[1] % 2**32
    x ^= x >> 16
    return sum(x >= limit for limit in B.LIMITS)


def test_weights_are_poisson():
    units = np.arange(4000, dtype=np.uint64) * 1_000_003 % 2**32
    w = B.weights(units, 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005
    # neither samples nor neighbouring units move together
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_weighted_sums(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), u % 40, draw.choice([None, 1.0, 2.5]), draw.randint(0, 3)) for u in range(200)]
    stats = spark.createDataFrame([(*r, "x") for r in rows], "slice string, unit long, m double, n int, sample string").drop("sample")
    got = B.weighted_sums(stats.repartition(4), ["unit"], ["slice"], ["m", "n"], SAMPLES).collect()
    assert len(got) == 2 * SAMPLES
    for r in got:
        mine = [(weight([u], r.sample), m or 0, n) for s, u, m, n in rows if s == r.slice]
        assert r.m == pytest.approx(sum(w * m for w, m, _ in mine)) and r.n == sum(w * n for w, _, n in mine)
    whole = B.weighted_sums(stats, ["unit"], [], ["n"], SAMPLES)
    assert whole.count() == SAMPLES
    assert B.weighted_sums(stats.limit(0), ["unit"], ["slice"], ["n"], SAMPLES).count() == 0


@pytest.mark.parametrize("hot_rows", [65_536, 20])
def test_ranking_samples(spark, hot_rows):
    draw = random.Random(4)
    rows = []
    for u in range(250):
        for day in (1, 2):
            # a third of the rows share one score; day 2 of few units has one class in many samples
            score = 0.5 if draw.random() < 0.34 else round(draw.random(), 2)
            rows.append((u, day, score, int(draw.random() < score) if day == 1 else int(u < 2)))
    df = spark.createDataFrame(rows + [(1, 1, None, 1), (2, 1, 0.3, None)], "unit long, day int, s double, y int").repartition(3)
    got = B.ranking_samples(df, ["unit"], ["day"], "s", "y", 0.5, SAMPLES, hot_rows=hot_rows).collect()
    assert len(got) == 2 * SAMPLES and any(r.roc_auc is None for r in got)
    for r in got:
        mine = [(weight([u], r.sample), s, y) for u, d, s, y in rows if d == r.day]
        pos, neg = (sum(w for w, _, y in mine if y == k) for k in (1, 0))
        tp, fp = (sum(w for w, s, y in mine if y == k and s >= 0.5) for k in (1, 0))
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, pos - tp, neg - fp)
        if not pos or not neg:
            assert r.roc_auc is None and r.average_precision is None
            continue
        ahead = sum(w * v * ((s > t) + (s == t) / 2) for w, s, y in mine if y for v, t, z in mine if not z)
        ap = 0.0
        for cut in {s for _, s, _ in mine}:
            seen = sum(w for w, s, _ in mine if s >= cut)
            hits = sum(w for w, s, y in mine if y and s >= cut)
            ap += sum(w for w, s, y in mine if y and s == cut) * (hits / seen if seen else 0)
        assert r.roc_auc == pytest.approx(ahead / pos / neg) and r.average_precision == pytest.approx(ap / pos)


def test_ranking_samples_without_rows(spark):
    df = spark.createDataFrame([], "unit long, day int, s double, y int")
    assert B.ranking_samples(df, ["unit"], ["day"], "s", "y", 0.5, 5).count() == 0


def test_seed_text(spark):
    row = spark.createDataFrame([(7, "M0")], "entity long, unit string").select(B.unit_seed(["unit", "entity"], 42).alias("u")).first()
    assert row.u == int(hashlib.md5(b"42|M0|7").hexdigest()[:8], 16)


def test_units_are_drawn_without_a_broadcast(spark):
    """A table of units grows with the input, so it never goes through the driver."""
    from tidemark.operators.resampling import resampled_weights

    units = spark.range(50).withColumnRenamed("id", "entity")
    drawn = resampled_weights(units, ["entity"], [], 3)
    got = drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    by_sample = {}
    for r in got:
        by_sample[r.sample] = by_sample.get(r.sample, 0) + r.w
    assert by_sample == {0: 50, 1: 50, 2: 50}
