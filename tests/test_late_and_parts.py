"""Late rows of a restarted stream, and permutation importance from parts of a logit."""

import random
from datetime import datetime, timedelta
from hashlib import md5

import numpy as np
import pytest

from tidemark.operators import explain as Ex
from tidemark.streaming import core, late


def test_late_rows_over_restarts(spark, tmp_path):
    start = datetime(2024, 1, 10)
    hours = [[0, 5, -300], [2, 40, 30], [1, 41, None], [14, 15, 17, 90]]
    got = None
    for k, batch in enumerate(hours):
        rows = [(10 * k + j, None if h is None else start + timedelta(hours=h)) for j, h in enumerate(batch)]
        df = spark.createDataFrame(rows, "id long, at timestamp").repartition(2)
        df.write.mode("append").parquet(f"{tmp_path}/inbox")
        stream = core.replay_source(spark, f"{tmp_path}/inbox", df.schema, files_per_trigger=None)
        got = late.collect_late(stream, f"{tmp_path}/late", "at", "24 HOURS")
    # a call without new input changes nothing
    got = late.collect_late(stream, f"{tmp_path}/late", "at", "24 HOURS").collect()
    assert len(got) == sum(map(len, hours)) and {r.batch_id for r in got} == {0, 1, 2, 3}
    # watermarks behind hours 5, 40 and 41: -19, 16 and 17
    assert {r.id for r in got if r.late} == {20, 30, 31}
    counts = {r.batch_id: r for r in late.late_counts(spark.createDataFrame(got), "at").collect()}
    assert (counts[3].rows, counts[3].late_rows, counts[3].most_seconds_behind) == (4, 2, 3 * 3600)
    with pytest.raises(ValueError):
        late.collect_late(stream.withColumnRenamed("id", "late"), f"{tmp_path}/other", "at", "1 HOUR")


def average_precision(raw, y):
    total, hits, seen = 0.0, 0, 0
    for cut in sorted(set(raw), reverse=True):
        here = [b for a, b in zip(raw, y) if a == cut]
        hits, seen = hits + sum(here), seen + len(here)
        total += sum(here) * hits / seen
    return total / sum(y)


@pytest.mark.parametrize("block_rows", [1024, 50])
def test_permutation_from_parts(spark, block_rows):
    draw = random.Random(8)
    rows = []
    for k in range(300):
        parts = [draw.randint(-8, 8) / 4, draw.randint(-8, 8) / 8, 0.0]
        rows.append((k, int(draw.random() < 1 / (1 + np.exp(-2 * parts[0]))), sum(parts) + 0.25, parts))
    df = spark.createDataFrame(rows, "k long, y int, raw double, parts array<double>").repartition(4)
    got = {r.feature: r for r in Ex.permutation_from_parts(df, ["a", "b", "c"], ["k"], "y", 4, 42, block_rows).collect()}
    order = sorted(rows, key=lambda r: (md5(f"42|{r[0]}".encode()).hexdigest()[:3], r[0]))
    blocks = -(-len(rows) // block_rows)
    base = average_precision([r[2] for r in rows], [r[1] for r in rows])
    for f, name in enumerate("abc"):
        losses = []
        for repeat in range(4):
            raw, y = [], []
            for b in range(blocks):
                mine = order[b::blocks]
                turn = 1 + int(md5(f"42|{name}|{repeat}|{b}".encode()).hexdigest()[:8], 16) % (len(mine) - 1)
                for j, r in enumerate(mine):
                    raw.append(r[2] - r[3][f] + mine[(j + turn) % len(mine)][3][f])
                    y.append(r[1])
            losses.append(base - average_precision(raw, y))
        assert got[name].importance_mean == pytest.approx(np.mean(losses))
        assert got[name].importance_standard_deviation == pytest.approx(np.std(losses), abs=1e-12) and got[name].repeats == 4
    assert got["a"].importance_mean > 0.1 and got["c"].importance_mean == pytest.approx(0)


def test_parts_add_up_to_the_score(spark):
    from tidemark.operators import models as Mo

    draw = random.Random(1)
    rows = [(k, draw.choice([None, draw.random()]), draw.random(), k % 3, int(draw.random() < 0.4)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, current_inactivity_gap double, active_days_last_7_days double, clicks_last_7_days int, y int")
    model = Mo.fit_base_model(df, df.columns[1:4], "y")
    parts = {r.k: r for r in Ex.logit_parts(model, df, ["k"], "y").collect()}
    scored = Mo.apply_base_model(model, df, "p", "raw").collect()
    assert all(len(parts[r.k].parts) == 3 and parts[r.k].raw == pytest.approx(r.raw) for r in scored)
    assert any(n.startswith(Mo.MISSING) for n in model.names)


def test_closing_a_stream_of_several_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds = "unit string, period string, entity long, event_time timestamp, day int, resource long, clicks long, activity_type string"
    rows = [("M", "P", e, start + timedelta(days=d, hours=h), d, 7, 2, "forumng") for d in (0, 1, 9) for e in (1, 2) for h in (1, 5)]
    for d in (0, 1, 9):
        spark.createDataFrame([r for r in rows if r[4] == d], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def source():
        return core.replay_source(spark, f"{tmp_path}/in", schema)

    half = core.drain(core.stream_daily(source(), "2024-01-01"), "half").collect()
    events, close = core.closable(source())
    whole = core.drain(core.stream_daily(events, "2024-01-01"), "whole", close=close).collect()
    assert sorted((r.entity, r.day, r.total_clicks) for r in whole) == [(e, d, 4) for e in (1, 2) for d in (0, 1, 9)]
    assert {r.day for r in half} == {0, 1}
    events, close = core.closable(source())
    sessions = core.drain(core.stream_sessions(events, "2024-01-01", 5), "sessions", close=close).collect()
    assert sorted((r.entity, r.first_day, r.last_day, r.clicks) for r in sessions) == [
        (e, a, b, c) for e in (1, 2) for a, b, c in ((0, 1, 8), (9, 9, 4))
    ]


def test_permutation_shuffles_each_block_once(spark):
    """The result reads written counts, so no reader of the curve repeats the shuffles."""
    from tidemark.operators import explain as Ex

    df = spark.range(50).selectExpr("id AS k", "CAST(id % 3 = 0 AS int) AS y", "id % 7 / 8.0D AS raw", "array(id % 7 / 8.0D) AS parts")
    out = Ex.permutation_from_parts(df, ["a"], ["k"], "y", 2)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
    assert out.count() == 1


@pytest.mark.parametrize("cell_rows", [1 << 20, 40])
def test_slices_are_shuffled_together(spark, monkeypatch, cell_rows):
    """All slices take the same two passes, and each has the losses it has alone, in cells of any size."""
    monkeypatch.setattr(Ex, "_CELL_ROWS", cell_rows)
    monkeypatch.setattr(Ex, "_CHUNK", 2)
    draw = random.Random(3)
    rows = []
    for k in range(500):
        fold = (k * k) % 7 % 3  # uneven slices; the labels of the last one are all 0
        parts = [draw.gauss(0, 2), draw.choice([-0.5, 0.0, 0.5])]
        rows.append((k, fold, int(fold < 2 and draw.random() < 1 / (1 + np.exp(-parts[0]))), sum(parts), parts))
    df = spark.createDataFrame(rows, "k long, fold int, y int, raw double, parts array<double>").repartition(3)
    out = Ex.permutation_from_parts(df, ["a", "b"], ["k"], "y", 3, 42, 64, by=["fold"])
    got = {(r.fold, r.feature): r for r in out.collect()}
    assert set(got) == {(f, x) for f in {r[1] for r in rows} for x in "ab"}
    for fold in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == fold), key=lambda r: (md5(f"42|{r[0]}".encode()).hexdigest()[:3], r[0]))
        blocks = -(-len(mine) // 64)
        for f, name in enumerate("ab"):
            r = got[fold, name]
            if not any(x[2] for x in mine):
                assert r.importance_mean is None and r.repeats == 3
                continue
            base, losses = average_precision([x[3] for x in mine], [x[2] for x in mine]), []
            for repeat in range(3):
                raw, y = [], []
                for b in range(blocks):
                    block = mine[b::blocks]
                    turn = 1 + int(md5(f"42|{name}|{repeat}|{b}".encode()).hexdigest()[:8], 16) % (len(block) - 1)
                    raw += [x[3] - x[4][f] + block[(j + turn) % len(block)][4][f] for j, x in enumerate(block)]
                    y += [x[2] for x in block]
                losses.append(base - average_precision(raw, y))
            assert r.importance_mean == pytest.approx(np.mean(losses)) and r.importance_standard_deviation == pytest.approx(np.std(losses))
