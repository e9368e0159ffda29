"""Models fitted together against models fitted one by one."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranking import set_quantiles
from tidemark.operators import fits as Fi
from tidemark.operators import holdout as H
from tidemark.operators import models as Mo


def observations(spark, n=300):
    draw = random.Random(3)
    rows = []
    for k in range(n):
        y = int(draw.random() < 0.3)
        gap = None if draw.random() < 0.15 else float(draw.randint(0, 20) + 4 * y)
        rows.append((k, k % 3 + 1, y, gap, 1000 + draw.gauss(-y, 2), draw.random() * 5000, 7.0, None))
    names = ["current_inactivity_gap", "click_z_score", "clicks_last_7_days", "historical_average_clicks", "days_since_last_activity"]
    return spark.createDataFrame(rows, "entity long, fold int, y int, " + ", ".join(f"{c} double" for c in names)).repartition(4), names


def test_models_of_one_scan_equal_single_fits(spark):
    df, names = observations(spark)
    groups = {"few": names[:2], "all": names}
    got = Fi.fold_scores(df.drop("fold"), df.select("entity", "fold"), 3, groups, "y", ["entity", "y"]).collect()
    assert len(got) == 600 and len({(r.entity, r.model) for r in got}) == 600
    for name, features in groups.items():
        for fold in (1, 2, 3):
            model = Mo.fit_base_model(df.where(F.col("fold") != fold), features, "y")
            wanted = {r.entity: r for r in Mo.apply_base_model(model, df.where(F.col("fold") == fold), "p", "raw").collect()}
            mine = {r.entity: r for r in got if r.model == name and r.fold == fold}
            assert mine.keys() == wanted.keys()
            for e, r in mine.items():
                assert r.logit == pytest.approx(wanted[e].raw, abs=1e-4) and r.score == pytest.approx(wanted[e].p, abs=1e-4)


def test_training_rows_of_one_class(spark):
    df, names = observations(spark, 30)
    with pytest.raises(ValueError):
        Fi.fold_scores(df.drop("fold").withColumn("y", F.lit(1)), df.select("entity", "fold"), 3, {"a": names}, "y", ["entity"])


def test_medians_of_overlapping_sets(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, 500 + draw.random() / 1e6, float(k % 9), -draw.random()]), [k % 2, int(k % 3 > 0), 1]) for k in range(9000)]
    df = spark.createDataFrame(rows, "v double, m array<tinyint>").withColumn("f", F.lit("x"))
    got = {r.member: r.quantiles[0] for r in set_quantiles(df, ["f"], "v", "m", 3, (0.5,)).collect()}
    assert got == {s: statistics.median([v for v, m in rows if v is not None and m[s]]) for s in range(3)}


def test_folds_of_all_holdouts_equal_single_ones(spark):
    draw = random.Random(9)
    rows = [(k % 70, draw.choice("abb") if k % 70 < 30 else "abc"[k % 3], int(draw.random() < 0.3)) for k in range(160)]
    df = spark.createDataFrame(rows, "entity long, h string, y int")
    folds, counts = H.strict_training_folds(df, "h", ["a", "b", "c"], "y", 4)
    got = {r.entity: r.folds for r in folds.collect()}
    for s, value in enumerate("abc"):
        wanted, count, _ = H.grouped_folds(H.leave_one_out(df, "h", value)[0], "y", 4)
        assert counts[s] == count
        assert {e: f[s] for e, f in got.items() if f[s]} == {r.entity: r.fold for r in wanted.collect()}
