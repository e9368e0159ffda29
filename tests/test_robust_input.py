"""Bad text, swapped columns, long histories and large row counts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.explain import _turn
from tidemark.operators.modeling import check_records
from tidemark.operators.review import priority_order
from tidemark.schema import CHANGE_FEATURES
from tidemark.sources.tables import COURSE_SCHEMA, read_csv, read_scoring_input


def test_swapped_columns_are_refused(spark, tmp_path):
    names = [f.name for f in COURSE_SCHEMA]
    folder = tmp_path / "courses"
    folder.mkdir()
    (folder / "a.csv").write_text("﻿" + ",".join(names) + "\nM,P,100\n")
    assert read_csv(spark, str(folder), COURSE_SCHEMA).first().length_days == 100
    (folder / "b.csv").write_text(",".join([names[1], names[0], names[2]]) + "\nP,M,90\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(folder), COURSE_SCHEMA).collect()


def test_bad_numbers_reject_their_row_only(spark, tmp_path):
    good = ["1"] * len(CHANGE_FEATURES)
    bad = ["abc", *good[1:]]
    (tmp_path / "in.csv").write_text("\n".join(",".join(r) for r in (CHANGE_FEATURES, good, bad)) + "\n")
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in CHANGE_FEATURES])
    rows = check_records(read_scoring_input(spark, str(tmp_path / "in.csv"), "csv", schema))
    assert [f.dataType.typeName() for f in rows.schema][: len(CHANGE_FEATURES)] == ["double"] * len(CHANGE_FEATURES)
    errors = {r.error for r in rows.collect()}
    assert errors == {None, f"{CHANGE_FEATURES[0]} must be numeric"}


def test_persistent_order_beyond_99_checkpoints(spark):
    rows = [(150, 150, 0.5), (151, 1, 0.5), (99, 99, 0.9), (151, 7, 0.1), (3, 2, 0.5), (3, 2, 0.7)]
    queue = spark.createDataFrame(rows, "alerting_checkpoints int, consecutive int, score double").select(
        "*",
        F.lit("persistent_warning").alias("priority_policy"),
        F.lit(1).alias("gap"),
        F.lit(0.1).alias("hybrid"),
        F.lit(1).alias("origin_day"),
    )
    cell = priority_order()[0]
    got = [(r[0], r[1], r[2]) for r in queue.withColumn("cell", cell).orderBy("cell").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], -r[1], -r[2]))


@pytest.mark.parametrize("n", [1, 2, 3, 1024])
def test_turns_move_every_row_of_a_block(n):
    turns = {_turn(42, f, r, b, n) for f in "fg" for r in range(5) for b in (0, 7, 2**40)}
    assert turns == {0} if n == 1 else all(0 < t < n for t in turns)


def test_numbers_are_checked_without_a_detour_over_text(spark):
    """Typed columns give the errors of their text, and no cast to text is planned for them."""
    typed = {n: "long" if n == "historical_windows_available" else "double" for n in CHANGE_FEATURES}
    odd = [None, -0.0, -1.5, 7.0, 7.5, 1e300, float("nan"), float("inf"), float("-inf")]
    rows = [[1 if t == "long" else 1.0 for t in typed.values()]]
    for i, t in enumerate(typed.values()):
        for v in [None, -1, 2**53 + 1] if t == "long" else odd:
            rows.append([*rows[0][:i], v, *rows[0][i + 1 :]])
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in typed.items()))
    numbers = check_records(frame)
    text = check_records(frame.select(*[F.col(n).cast("string") for n in CHANGE_FEATURES]))
    count = lambda df: sorted((str(r.error), r["count"]) for r in df.groupBy("error").count().collect())
    assert count(numbers) == count(text) and numbers.where("error IS NULL").count() < len(rows)
    assert "as string" not in numbers._jdf.queryExecution().optimizedPlan().toString()
