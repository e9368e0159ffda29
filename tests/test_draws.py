"""Draws of n of n units against hashlib, and their sums against a table of draws."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import resampling as checks
from tidemark.operators import draws as D
from tidemark.operators.resampling import resampled_weights

SAMPLES = 12


def test_drawn_units_are_md5():
    got = D.drawn_units(42, 7, 95, 20_011, 9_001)
    want = [int(hashlib.md5(f"42|7|{i}".encode()).hexdigest()[:15], 16) % 9_001 for i in range(95, 20_011)]
    assert got.tolist() == want
    for first in (2**32 - 3, 10**12):
        want = [int(hashlib.md5(f"42|x|{i}".encode()).hexdigest()[:15], 16) for i in range(first, first + 6)]
        assert D._hash_ints(b"42|x|", np.arange(first, first + 6)).tolist() == want


@pytest.mark.parametrize("piece", [1 << 22, 1000])
def test_sums_equal_a_table_of_draws(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "_PIECE", piece)
    random.seed(5)
    units = spark.createDataFrame([(u, f"p{u % 3}") for u in range(2500)], "entity long, period string")
    rows = [(random.randrange(2600), random.choice("ab"), random.choice([None, 1, 4]), random.randrange(5)) for _ in range(4000)]
    rows += [(3, "rare", 2, 2), (None, "a", 1, 1)]
    stats = spark.createDataFrame(rows, "entity long, slice string, m long, n long").withColumn("period", F.format_string("p%d", F.col("entity") % 3))
    keys = ["entity", "period"]
    got = D.draw(units, keys, SAMPLES).sums(stats.repartition(5), ["slice"], ["m", "n"])
    table = resampled_weights(units, keys, [], SAMPLES)
    want = (
        stats.join(table, keys).groupBy("slice", "sample")
        .agg(*[F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("w")).cast("double").alias(c) for c in ("m", "n")])
    )
    wanted = {tuple(r) for r in want.collect()}
    assert {tuple(r) for r in got.select(*want.columns).collect()} == wanted
    # a slice of one unit has no row in the samples that did not draw it
    assert 0 < sum(r[0] == "rare" for r in wanted) < SAMPLES


def test_no_units(spark):
    units = spark.range(0).withColumnRenamed("id", "entity")
    stats = spark.range(5).select(F.col("id").alias("entity"), F.lit(1).alias("n"))
    assert D.draw(units, ["entity"], 4).sums(stats, [], ["n"]).count() == 0


def test_workload_intervals_draw_a_thousand_samples(monkeypatch):
    """k05 drew 20 samples where its operator, and the reference, draw 1,000."""
    seen = {}
    monkeypatch.setattr(checks.Rs, "workload_intervals", lambda *tables, **settings: seen.update(settings) or "rows")
    monkeypatch.setattr(checks, "tidy", lambda rows: rows)
    monkeypatch.setattr("checks.review.events", lambda spark, sf: "events")
    monkeypatch.setattr("tidemark.plans.audits.workload_comparison", lambda *_: {"cases": 0, "scenarios": 0})
    assert checks.workload_intervals(None, "") == "rows" and seen["samples"] == 1000
    assert "range(1000) r(b)" in checks._K5 and "1000 - count(value) AS skipped_samples" in checks._K5
