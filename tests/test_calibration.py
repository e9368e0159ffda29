"""Grouped Newton fits and mergeable isotonic mappings against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C


def newton(points, penalty=0.0, rounds=60):
    a = b = 0.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            p = 1 / (1 + math.exp(-(a + b * x)))
            g0, g1 = g0 + y - p, g1 + (y - p) * x
            w = p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g1, h11 = g1 - penalty * b, h11 + penalty
        det = h00 * h11 - h01 * h01
        a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
    return a, b


def pooled(points):
    """Score -> fitted value by the max-min formula."""
    scores = sorted({s for s, _ in points})
    n = [sum(s == t for t, _ in points) for s in scores]
    y = [sum(v for t, v in points if t == s) for s in scores]
    mean = lambda j, k: sum(y[j : k + 1]) / sum(n[j : k + 1])
    return {
        s: max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i, s in enumerate(scores)
    }


def read(points, fitted, x):
    known = sorted(fitted)
    if x <= known[0]:
        return fitted[known[0]]
    if x >= known[-1]:
        return fitted[known[-1]]
    lo, hi = max(s for s in known if s <= x), min(s for s in known if s >= x)
    if lo == hi:
        return fitted[lo]
    return fitted[lo] + (x - lo) / (hi - lo) * (fitted[hi] - fitted[lo])


def slices():
    draw = random.Random(11)
    out = {}
    for name, size in (("a", 40), ("b", 90), ("c", 25)):
        scores = [round(draw.random(), 2) for _ in range(size)]
        # a third of the rows share one score
        scores[: size // 3] = [0.37] * (size // 3)
        out[name] = [(s, int(draw.random() < s)) for s in scores]
    return out


def frame(spark, rows):
    flat = [(k, s, y, 1.0) for k, points in rows.items() for s, y in points]
    return spark.createDataFrame(flat, "slice string, score double, y int, x double").repartition(5)


def test_lines_and_sigmoids_per_slice(spark):
    rows = slices()
    special = {"one": [(0.2, 1), (0.9, 1)], "apart": [(0.1, 0), (0.2, 0), (0.8, 1)], "same": [(0.5, 0), (0.5, 1)], "none": [(None, 1), (0.5, None)]}
    df = frame(spark, rows | special)
    logit = lambda p: math.log(min(max(p, 1e-15), 1 - 1e-15) / (1 - min(max(p, 1e-15), 1 - 1e-15)))
    got = {r.slice: r for r in C.calibration_lines(df, ["slice"], "score", "y").collect()}
    sigmoid = {r.slice: r for r in C.sigmoid_mappings(df, ["slice"], "score", "y").collect()}
    for k, points in rows.items():
        points = [(logit(s), y) for s, y in points]
        assert (got[k].calibration_intercept, got[k].calibration_slope) == pytest.approx(newton(points), abs=1e-6)
        assert (sigmoid[k].intercept, sigmoid[k].slope) == pytest.approx(newton(points, 1.0), abs=1e-6)
        assert got[k].calibration_diagnostic_warning is None and sigmoid[k].reason is None
    assert got["one"].calibration_diagnostic_warning == C.ONE_CLASS
    assert got["apart"].calibration_diagnostic_warning == got["same"].calibration_diagnostic_warning == C.NOT_CONVERGED
    assert got["apart"].calibration_slope is None and "none" not in got
    # a penalty keeps the slope of separated classes finite
    assert sigmoid["apart"].slope == pytest.approx(newton([(logit(s), y) for s, y in special["apart"]], 1.0)[1], abs=1e-6)
    assert C.calibration_lines(df.limit(0), ["slice"], "score", "y").count() == 0
    with pytest.raises(ValueError):
        C.calibration_lines(df, [], "score", "y")


def test_steep_fit_is_damped(spark):
    # an undamped Newton step overshoots here
    points = [(-30.0, 0)] * 400 + [(-29.0, 1)] + [(30.0, 1)] * 3 + [(29.0, 0)]
    df = spark.createDataFrame([("s", x, y) for x, y in points], "slice string, x double, y int")
    r = C.grouped_logistic(df, ["slice"], F.col("x"), "y").first()
    assert r.reason is None
    g0 = sum(y - 1 / (1 + math.exp(-(r.intercept + r.slope * x))) for x, y in points)
    g1 = sum((y - 1 / (1 + math.exp(-(r.intercept + r.slope * x)))) * x for x, y in points)
    assert abs(g0) < 1e-5 and abs(g1) < 1e-4


def test_isotonic_blocks_and_reading(spark):
    rows = slices() | {"one": [(0.4, 1)], "falling": [(0.1, 1), (0.2, 1), (0.3, 0), (0.9, 0)]}
    df = frame(spark, rows)
    blocks = C.isotonic_blocks(df, ["slice"], "score", "y")
    asked = [(k, round(x / 50 - 0.1, 3)) for k in rows for x in range(60)] + [("a", None), ("unknown", 0.5)]
    ask = spark.createDataFrame([(k, x, 7) for k, x in asked], "slice string, score double, value int")
    got = {(r.slice, r.score): r for r in C.apply_isotonic(ask, ["slice"], "score", blocks, "out").collect()}
    assert len(got) == len(asked) and got["a", None].out is None and got["unknown", 0.5].out is None
    for k, points in rows.items():
        fitted = pooled(points)
        for x in (x for s, x in asked if s == k and x is not None):
            assert got[k, x].out == pytest.approx(read(points, fitted, x), abs=1e-12) and got[k, x].value == 7
    whole = C.isotonic_blocks(df.where("slice = 'b'"), [], "score", "y").orderBy("low").collect()
    assert [(r.low, r.high, r.value) for r in whole] == [
        (r.low, r.high, r.value) for r in blocks.where("slice = 'b'").orderBy("low").collect()
    ]
    assert all(p.value < q.value and p.high < q.low for p, q in zip(whole, whole[1:]))
    assert C.isotonic_blocks(df.limit(0), ["slice"], "score", "y").count() == 0


def test_isotonic_on_many_scores_in_one_cell(spark):
    # 12,000 scores within one hundredth: cut into several cells, merged again
    rows = spark.range(12_000).select(
        (F.lit(0.5) + F.col("id") / 5e6).alias("score"), (F.xxhash64("id") % 12_000 > F.lit(6_000) - F.col("id")).cast("int").alias("y")
    )
    blocks = C.isotonic_blocks(rows, [], "score", "y").orderBy("low").collect()
    want = []
    for s, y in sorted((r.score, r.y) for r in rows.collect()):
        want.append([s, s, y, 1])
        while len(want) > 1 and want[-2][2] * want[-1][3] >= want[-1][2] * want[-2][3]:
            _, high, p, n = want.pop()
            want[-1] = [want[-1][0], high, want[-1][2] + p, want[-1][3] + n]
    assert [[r.low, r.high, r.pos, r.n] for r in blocks] == want


def test_few_positives_message(spark):
    df = frame(spark, {"few": [(0.5, 1)] * 99 + [(0.5, 0)], "enough": [(0.5, 1)] * 100})
    assert [tuple(r) for r in C.calibration_messages(df, ["slice"], "y").collect()] == [
        ("few", "Isotonic calibration has only 99 positive inner OOF rows and may be unstable")
    ]
