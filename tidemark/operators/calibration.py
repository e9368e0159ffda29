"""Calibration of many slices at once: one-feature logistic fits and isotonic mappings.

Both work on counts per slice and distinct score, so a hot score is one row.
Logistic fits are Newton steps for all slices together: a round is one
map-side aggregation of each slice's two-by-two normal equations.  Isotonic
fits pool adjacent violators within ranges of scores, and ranges merge level by
level, because pooled blocks pool to the same result as their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import value_cells
from tidemark.functions.scalars import clamp01, inverse_logit, logit
from tidemark.session import cut_lineage

ONE_CLASS = "Calibration intercept/slope require both classes"
NOT_CONVERGED = "Calibration diagnostic did not converge"
FEW_POSITIVES = 100


def _counted(rows: DataFrame, by: Sequence[str], x: Column, label: str) -> DataFrame:
    y = F.col(label).cast("long")
    known = rows.select(*by, x.cast("double").alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return known.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def _known_logit(score: str) -> Column:
    """Clipped logit; null where the score is null (the smallest of several skips nulls)."""
    return F.when(F.col(score).isNotNull(), logit(F.col(score)))


_STATE = ("a", "b", "old_a", "old_b", "step_a", "step_b", "old_loss", "rounds", "done")


def _newton_round(counted: DataFrame, state: DataFrame, by: Sequence[str], penalty: float, tolerance: float) -> DataFrame:
    """One Newton step of every open slice; a step that raises the loss is halved instead."""
    z = F.col("a") + F.col("b") * F.col("x")
    open_rows = counted.join(state.where(~F.col("done")).select(*by, "a", "b"), list(by))
    p = open_rows.select(*by, "x", "n", "pos", z.alias("z")).withColumn("p", inverse_logit(F.col("z")))
    weight = F.col("n") * F.col("p") * (1 - F.col("p"))
    miss = F.col("pos") - F.col("n") * F.col("p")
    softplus = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
    sums = p.groupBy(*by).agg(
        F.sum(miss).alias("g0"),
        F.sum(miss * F.col("x")).alias("g1"),
        F.sum(weight).alias("h00"),
        F.sum(weight * F.col("x")).alias("h01"),
        F.sum(weight * F.col("x") * F.col("x")).alias("h11"),
        F.sum(F.col("n") * softplus - F.col("pos") * F.col("z")).alias("loss"),
    )
    joined = state.join(sums, list(by), "left")
    ridge = F.lit(float(penalty))
    loss = F.col("loss") + ridge / 2 * F.col("b") * F.col("b")
    g1, h11 = F.col("g1") - ridge * F.col("b"), F.col("h11") + ridge
    det = F.col("h00") * h11 - F.col("h01") * F.col("h01")
    # a flat direction (one distinct score) has no slope
    flat = det <= F.lit(1e-12) * F.col("h00") * h11
    da = F.when(~flat, (h11 * F.col("g0") - F.col("h01") * g1) / det)
    db = F.when(~flat, (F.col("h00") * g1 - F.col("h01") * F.col("g0")) / det)
    worse = loss > F.col("old_loss") + F.lit(1e-9) * (1 + F.abs("old_loss"))
    small = (F.abs(da) <= tolerance * (1 + F.abs("a"))) & (F.abs(db) <= tolerance * (1 + F.abs("b")))
    step = joined.withColumns(
        {
            "new_loss": loss,
            "da": da,
            "db": db,
            "worse": F.coalesce(worse, F.lit(False)),
            "small": F.coalesce(small, F.lit(False)),
        }
    )
    from_a, from_b = (F.when(F.col("worse"), F.col(f"old_{c}")).otherwise(F.col(c)) for c in "ab")
    by_a, by_b = (F.when(F.col("worse"), F.col(f"step_{c}") / 2).otherwise(F.col(f"d{c}")) for c in "ab")
    new = {
        "a": from_a + by_a,
        "b": from_b + by_b,
        "old_a": from_a,
        "old_b": from_b,
        "step_a": by_a,
        "step_b": by_b,
        "old_loss": F.when(F.col("worse"), F.col("old_loss")).otherwise(F.col("new_loss")),
        "rounds": F.col("rounds") + 1,
        "done": F.col("small") & ~F.col("worse"),
    }
    keep = F.col("done") | F.col("new_loss").isNull()
    return step.select(*by, *[F.when(keep, F.col(c)).otherwise(new[c]).alias(c) for c in _STATE])


def grouped_logistic(
    rows: DataFrame,
    by: Sequence[str],
    x: Column,
    label: str,
    penalty: float = 0.0,
    max_rounds: int = 32,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Logistic regression of ``label`` on ``x`` in every slice: ``by``, rows, positives, intercept, slope, reason.

    ``penalty`` weighs half the squared slope against the summed log loss; the
    intercept is free.  Slices are named by columns that are never null.  Rows with
    a null ``x`` or label are left out.  Where ``reason`` is set, intercept and
    slope are null: one class only, or no convergence (separated classes without a
    penalty, one distinct ``x``).
    """
    by = list(by)
    if not by:
        raise ValueError("name at least one slice column")
    counted = cut_lineage(_counted(rows, by, x, label))
    totals = cut_lineage(counted.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives")))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    start = dict(zip(_STATE, (zero, zero, zero, zero, none, none, none, F.lit(0), F.lit(False))))
    state = totals.where(both).select(*by, *[c.alias(n) for n, c in start.items()])
    for done in range(0, max_rounds, 4):
        for _ in range(min(4, max_rounds - done)):
            state = _newton_round(counted, state, by, penalty, tolerance)
        state = cut_lineage(state)
        # a flat slice has null parameters and stays so
        if state.where(~F.col("done") & F.col("a").isNotNull()).limit(1).count() == 0:
            break
    good = F.col("done") & F.col("a").isNotNull()
    return totals.join(state, by, "left").select(
        *by,
        "rows",
        "positives",
        F.when(good, F.col("a")).alias("intercept"),
        F.when(good, F.col("b")).alias("slope"),
        F.when(~both, F.lit(ONE_CLASS)).when(~F.coalesce(good, F.lit(False)), F.lit(NOT_CONVERGED)).alias("reason"),
    )


def calibration_lines(rows: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Intercept and slope of the outcome on the score's clipped logit per slice, with the reason where there is none."""
    return grouped_logistic(rows, by, _known_logit(score), label).select(
        *by,
        F.col("intercept").alias("calibration_intercept"),
        F.col("slope").alias("calibration_slope"),
        F.col("reason").alias("calibration_diagnostic_warning"),
    )


def sigmoid_mappings(rows: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Intercept and slope of the sigmoid mapping per slice: unit penalty on the slope, clipped logits."""
    return grouped_logistic(rows, by, _known_logit(score), label, penalty=1.0)


def apply_sigmoid(rows: DataFrame, by: Sequence[str], score: str, mappings: DataFrame, out: str = "calibrated_output") -> DataFrame:
    """``rows`` with the slice's sigmoid of its score; null scores give null, slices without a mapping are left out."""
    lines = mappings.where("slope IS NOT NULL").select(*by, F.struct("intercept", "slope").alias("_line"))
    x = F.col("_line.intercept") + F.col("_line.slope") * _known_logit(score)
    return rows.join(lines, list(by)).withColumn(out, F.when(x.isNotNull(), clamp01(inverse_logit(x)))).drop("_line")


def _pool(low: list, high: list, pos: list, n: list) -> list[list]:
    """Pool neighbours, in order, until means rise; whole-number sums, so ties are exact."""
    out: list[list] = []
    for block in zip(low, high, pos, n):
        a, b, p, k = block
        while out and out[-1][2] * k >= p * out[-1][3]:
            a, _, before, count = out.pop()
            p, k = p + before, k + count
        out.append([a, b, p, k])
    return out


def isotonic_blocks(rows: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Blocks of the rising step function that fits 0/1 labels best in every slice.

    Columns: ``by``, low, high (first and last score of the block), pos, n, value.
    Scores are pooled in cells of bounded size, then in ever wider ranges of
    cells.  With 0/1 labels the blocks of n rows are at most about n^(2/3), which
    bounds the last level.  Null scores and labels are left out; slice columns are
    never null.
    """
    by = list(by)
    cells = value_cells(_counted(rows, by, F.col(score), label), by, "x")
    ends = [F.col("x").alias("low"), F.col("x").alias("high")]
    blocks = cells.select(*by, F.col("cell.grid").alias("grid"), F.col("cell.part").alias("part"), *ends, "pos", "n")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def level(blocks: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
        carried = [*keys, *rest]

        def pool(group: pa.Table) -> pa.Table:
            group = group.sort_by("low")
            pooled = _pool(*(group.column(c).to_pylist() for c in ("low", "high", "pos", "n")))
            # every other column is the same in the whole group
            fixed = {c: pa.repeat(group.column(c)[0], len(pooled)) for c in carried}
            values = zip(("low", "high", "pos", "n"), zip(*pooled))
            return pa.table(fixed | {c: pa.array(v, group.schema.field(c).type) for c, v in values})

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*carried, "low", "high", "pos", "n"])
        return blocks.select(*carried, "low", "high", "pos", "n").groupBy(*keys).applyInArrow(pool, schema)

    blocks = level(blocks, [*by, "grid", "part"], [])
    for _ in range(2):
        blocks = level(blocks.withColumn("grid", F.shiftright("grid", 4)), [*by, "grid"], [])
    if by:
        blocks = level(blocks, by, [])
    else:
        kinds["all"] = "int"
        blocks = level(blocks.withColumn("all", F.lit(1)), ["all"], []).drop("all")
    return blocks.withColumn("value", F.col("pos") / F.col("n"))


def apply_isotonic(rows: DataFrame, by: Sequence[str], score: str, blocks: DataFrame, out: str = "calibrated_output") -> DataFrame:
    """``rows`` with the slice's fitted value: constant within blocks, linear between them, clipped outside.

    Null scores give null.  A slice without blocks gives null.
    """
    by = list(by)
    names = [f"_by{k}" for k in range(len(by))]
    keyed = lambda df: [F.col(c).alias(n) for c, n in zip(by, names)]
    ends = F.explode(F.array(F.struct(F.col("low").alias("x"), "value"), F.struct(F.col("high").alias("x"), "value")))
    points = blocks.select(*keyed(blocks), ends.alias("p")).select(*names, "p.x", "p.value")
    asked = rows.select(*keyed(rows), F.col(score).cast("double").alias("x"), F.lit(None).cast("double").alias("value"))
    both = asked.where("x IS NOT NULL").unionByName(points).groupBy(*names, "x").agg(F.max("value").alias("value"))
    cells = cut_lineage(value_cells(both, names, "x"))
    point = F.when(F.col("value").isNotNull(), F.struct("x", "value"))
    edges = cells.where("value IS NOT NULL").groupBy(*names, "cell").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    edges = cells.select(*names, "cell").distinct().join(edges, [*names, "cell"], "left")
    # a slice has a few thousand cells
    along = W.partitionBy(*(names or [F.lit(0)])).orderBy("cell")
    edges = edges.select(
        *names,
        "cell",
        F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("after"),
    )
    inside = W.partitionBy(*names, "cell").orderBy("x")
    left = F.coalesce(F.last(point, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("before"))
    right = F.coalesce(F.first(point, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col("after"))
    mapped = cells.join(edges, [*names, "cell"]).select(*names, F.col("x").alias("_x"), left.alias("l"), right.alias("r"))
    share = (F.col("_x") - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))
    value = (
        F.when(F.col("l").isNull(), F.col("r.value"))
        .when(F.col("r").isNull() | (F.col("l.x") == F.col("r.x")), F.col("l.value"))
        .otherwise(F.col("l.value") + share * (F.col("r.value") - F.col("l.value")))
    )
    mapped = cut_lineage(mapped.select(*names, "_x", F.when(value.isNotNull(), clamp01(value)).alias("_value")))
    on = F.col(score).cast("double") == F.col("_x")
    for c, n in zip(by, names):
        on = on & (F.col(c) == F.col(n))
    return rows.join(mapped, on, "left").withColumn(out, F.col("_value")).drop(*names, "_x", "_value")


def calibration_messages(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """``by`` and warning: slices whose isotonic mapping rests on few positive rows."""
    positives = rows.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("positives")).where(F.col("positives") < FEW_POSITIVES)
    text = F.format_string("Isotonic calibration has only %d positive inner OOF rows and may be unstable", "positives")
    return positives.select(*by, text.alias("warning"))
