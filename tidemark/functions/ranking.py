"""Running totals, exact quantiles and top-k without one task per group.

A window ordered over a whole slice puts that slice into one task.  The
functions here cut each slice into *cells*: a fixed, monotone function of the
ordering value.  Cell totals are small, so their running totals give every cell
its starting offset, and the remaining ordering happens inside one cell at a
time.  ``value_cells`` also cuts cells with many distinct values between their
smallest and largest value.  A cell depends on the values only, never on their
order or placement, so recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_bucket, logit


_CELL_VALUES = 4096


def score_cell(score: Column, per_unit: int = 64) -> Column:
    """Cell of a probability on the log-odds axis (about 4,400 cells)."""
    return F.floor(logit(score) * F.lit(float(per_unit))).cast("long")


def value_cell(value: Column, per_octave: int = 64) -> Column:
    """Cell of any finite number: about 1 % of its size wide, at every magnitude."""
    size = F.floor(F.log2(F.abs(value)) * F.lit(float(per_octave))) + 1100 * per_octave
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def _crowded_cells(rows: DataFrame, by: Sequence[str], value: str, cell_values: int) -> DataFrame:
    """Grid cells with more than ``cell_values`` rows: their range, and the parts to cut it into."""
    return (
        rows.groupBy(*by, "grid")
        .agg(F.count(F.lit(1)).alias("inside"), F.min(value).alias("low"), F.max(value).alias("high"))
        .where((F.col("inside") > cell_values) & (F.col("high") > F.col("low")))
        .select(*by, "grid", "low", "high", F.ceil(F.col("inside") / cell_values).alias("parts"))
    )


def _cut_cells(rows: DataFrame, crowded: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``cell``, which orders as the values do, in place of ``grid``."""
    along = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts"))
    part = F.greatest(F.lit(0), F.least(F.col("parts") - 1, along))
    return (
        rows.join(crowded, [*by, "grid"], "left")
        .withColumn("cell", F.struct("grid", F.coalesce(part, F.lit(0)).alias("part")))
        .drop("grid", "low", "high", "parts")
    )


def value_cells(df: DataFrame, by: Sequence[str], value: str, cell_values: int = _CELL_VALUES) -> DataFrame:
    """Add ``cell`` for running totals over ``value``; ``df`` holds one row per ``by`` and value.

    A grid cell with more than ``cell_values`` values is cut into equal parts of
    the range they span.  Nulls and zero share a cell.
    """
    rows = df.withColumn("grid", value_cell(F.col(value)))
    return _cut_cells(rows, _crowded_cells(rows, by, value, cell_values), by, value)


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on never-null keys; both sides are shuffled on the same keys."""
    return left.join(right, list(keys), how)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    cell: Column,
    sums: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_*`` (inclusive) and ``all_*`` totals for each column in ``sums``.

    ``df`` must hold one row per ``by`` + ``order`` value.
    """
    by = list(by)
    first = F.col("cell").desc() if descending else F.col("cell").asc()
    within = F.col(order).desc() if descending else F.col(order).asc()
    base = df.withColumn("cell", cell)
    totals = base.groupBy(*by, "cell").agg(*[F.sum(c).alias(f"s_{c}") for c in sums])
    slice_window = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = slice_window.orderBy(first).rowsBetween(W.unboundedPreceding, -1)
    whole = slice_window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        *by,
        "cell",
        *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums],
        *[F.sum(f"s_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy(*by, "cell").orderBy(within).rowsBetween(W.unboundedPreceding, 0)
    joined = _match(base, offsets, [*by, "cell"])
    return joined.select(
        *df.columns,
        *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def average_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    cell: Column | None = None,
    few_values: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Per distinct value: 1-based average rank, tie count and slice size.

    Result columns: ``by``, ``value``, ``ties``, ``rank``, ``n``.  With
    ``few_values`` (course days, checkpoint counts) the distinct values of a
    slice are ordered directly, because there are only hundreds of them.
    ``weight`` says for how many rows a row of ``df`` stands.
    """
    counts = df.groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("ties"))
    if few_values:
        part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        upto = part.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        whole = part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        run = counts.withColumns(
            {"cum_ties": F.sum("ties").over(upto), "all_ties": F.sum("ties").over(whole)}
        )
    else:
        if cell is None:
            counts, cell = value_cells(counts, by, value), F.col("cell")
        run = running_totals(counts, by, value, cell, ["ties"])
    return run.select(
        *by,
        value,
        "ties",
        ((2 * F.col("cum_ties") - F.col("ties") + 1) / F.lit(2.0)).alias("rank"),
        F.col("all_ties").alias("n"),
    )


def value_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    alias: str,
    cell: Column | None = None,
    few_values: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Average-rank percentile in [0, 1] of each distinct value; slices of one row give 1."""
    return average_rank(df, by, value, cell, few_values, weight).select(
        *by,
        value,
        F.when(F.col("n") <= 1, F.lit(1.0))
        .otherwise((F.col("rank") - 1) / (F.col("n") - 1))
        .alias(alias),
    )


def percentile_rank(
    df: DataFrame, by: Sequence[str], value: str, alias: str, cell: Column | None = None, few_values: bool = False
) -> DataFrame:
    """Add the average-rank percentile in [0, 1]; slices of one row give 1."""
    return _match(df, value_percentiles(df, by, value, alias, cell, few_values), [*by, value])


def _target_cells(spans: DataFrame, by: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Cells that hold a wanted rank, with the ranks counted from the cell start."""
    slice_window = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = slice_window.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    whole = slice_window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spans = spans.where("cw > 0").select(
        *by,
        "cell",
        "cw",
        F.coalesce(F.sum("cw").over(before), F.lit(0)).alias("start"),
        F.sum("cw").over(whole).alias("n"),
    )
    position = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), x.alias("position"), rank(x).alias("r"))
            for i, x in enumerate(position)
            for side, rank in ((0, F.floor), (1, F.ceil))
        ]
    )
    inside = F.filter(
        wanted,
        lambda t: (t.r >= F.col("start")) & (t.r < F.col("start") + F.col("cw")),
    )
    return spans.withColumn("ts", inside).where(F.size("ts") > 0).select(*by, "cell", "start", "ts")


def _pick_ranks(counted: DataFrame, by: list[str]) -> DataFrame:
    """Quantile arrays from counted values of the target cells."""
    inside = W.partitionBy(*by, "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    picked = (
        counted.withColumn("upto", F.col("start") + F.sum("w").over(inside))
        .withColumn("t", F.explode("ts"))
        .where((F.col("t.r") < F.col("upto")) & (F.col("t.r") >= F.col("upto") - F.col("w")))
        .groupBy(*by, "t.i")
        .agg(
            F.max(F.when(F.col("t.side") == 0, F.col("v"))).alias("low"),
            F.max(F.when(F.col("t.side") == 1, F.col("v"))).alias("high"),
            F.max(F.col("t.position") - F.floor("t.position")).alias("part"),
        )
        .select(*by, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))
    )
    return picked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x.q).alias("quantiles")
    )


def _counted_values(df: DataFrame, keep: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One counted row per slice and distinct value, with its grid cell.

    Counting first means that a value shared by many rows is one row from then on.
    """
    multiplicity = F.lit(1) if weight is None else F.col(weight)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keep, F.col(value).cast("double").alias("v"))
        .agg(F.sum(multiplicity.cast("long")).alias("w"))
        .withColumn("grid", value_cell(F.col("v")))
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles as an array column ``quantiles``.

    Only the cells that hold a wanted rank are ordered.  ``weight`` is an
    optional integer multiplicity.  Nulls are ignored; slices without any
    value do not appear.
    """
    by = list(by)
    rows = _counted_values(df, by, value, weight)
    rows = _cut_cells(rows, _crowded_cells(rows, by, "v", _CELL_VALUES), by, "v")
    targets = _target_cells(rows.groupBy(*by, "cell").agg(F.sum("w").alias("cw")), by, probabilities)
    return _pick_ranks(_match(rows.where("w > 0"), targets, [*by, "cell"]), by)


def complement_quantiles(
    everything: DataFrame,
    left_out: DataFrame,
    by: Sequence[str],
    group: str,
    value: str,
    probabilities: Sequence[float],
) -> DataFrame:
    """Exact quantiles of "all rows of ``by`` except those left out of ``group``".

    ``left_out`` names, per group, the rows that do not count.  Cell totals are
    subtracted, so the full table is never repeated per group: only values in
    the few cells around the wanted ranks are compared group by group.
    """
    by = list(by)
    rows = _counted_values(everything, by, value)
    crowded = _crowded_cells(rows, by, "v", _CELL_VALUES)
    rows = _cut_cells(rows, crowded, by, "v")
    out = _cut_cells(_counted_values(left_out, [*by, group], value), crowded, by, "v")
    groups = left_out.select(*by, group).distinct()
    all_cells = rows.groupBy(*by, "cell").agg(F.sum("w").alias("cw"))
    spans = (
        all_cells.join(groups, by)
        .select(*by, group, "cell", "cw")
        .unionByName(out.groupBy(*by, group, "cell").agg((-F.sum("w")).alias("cw")))
        .groupBy(*by, group, "cell")
        .agg(F.sum("cw").alias("cw"))
    )
    targets = _target_cells(spans, [*by, group], probabilities)
    plus = rows.join(targets.select(*by, "cell", group), [*by, "cell"])
    minus = _match(
        out, targets.select(*by, group, "cell"), [*by, group, "cell"], "left_semi"
    ).withColumn("w", -F.col("w"))
    columns = [*by, group, "cell", "v", "w"]
    counted = (
        plus.select(*columns)
        .unionByName(minus.select(*columns))
        .groupBy(*by, group, "cell", "v")
        .agg(F.sum("w").alias("w"))
        .where("w > 0")
    )
    return _pick_ranks(_match(counted, targets, [*by, group, "cell"]), [*by, group])


def set_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    member: str,
    sets: int,
    probabilities: Sequence[float],
) -> DataFrame:
    """Exact quantiles of ``sets`` overlapping sets of rows: ``member``, ``by`` and ``quantiles``.

    The array ``member`` of a row holds 1 for each set it is in and 0 for the
    others.  Cells of all sets are counted together; only rows of the few cells
    around the wanted ranks are repeated per set.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.col(member).alias("in"))
    rows = rows.withColumn("grid", value_cell(F.col("v")))
    rows = _cut_cells(rows, _crowded_cells(rows, by, "v", _CELL_VALUES), by, "v")
    cells = rows.groupBy(*by, "cell").agg(*[F.sum(F.col("in")[i].cast("long")).alias(f"c{i}") for i in range(sets)])
    spans = cells.select(*by, "cell", F.posexplode(F.array(*[f"c{i}" for i in range(sets)])).alias("member", "cw"))
    # a row or two for each set and slice
    targets = F.broadcast(_target_cells(spans, [*by, "member"], probabilities))
    counted = (
        rows.join(targets.select(*by, "cell", "member"), [*by, "cell"])
        .where(F.col("in")[F.col("member")] == 1)
        .groupBy(*by, "member", "cell", "v")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return _pick_ranks(counted.join(targets, [*by, "member", "cell"]), [*by, "member"])


def top_k(
    df: DataFrame,
    by: Sequence[str],
    k: str,
    cell: Column,
    order: Sequence[Column],
    spread: str,
    eligible: Column,
    alias: str = "selected",
) -> DataFrame:
    """Flag the first ``k`` eligible rows of each slice in a total order.

    ``cell`` ascends with the order.  Rows of cells that lie wholly inside or
    outside the cut are decided by cell totals; only the cell on the boundary
    is ordered, and other rows are spread by ``spread`` to keep tasks even.
    """
    base = df.withColumn("tk_in_play", F.coalesce(eligible, F.lit(False))).withColumn(
        "tk_cell", F.when(F.col("tk_in_play"), cell)
    )
    counts = base.where("tk_in_play").groupBy(*by, "tk_cell").agg(F.count(F.lit(1)).alias("tk_in_cell"))
    before = W.partitionBy(*by).orderBy("tk_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "tk_cell", "tk_in_cell", F.coalesce(F.sum("tk_in_cell").over(before), F.lit(0)).alias("tk_ahead")
    )
    joined = _match(base, offsets, [*by, "tk_cell"], "left")
    edge = (
        F.col("tk_in_play")
        & (F.col("tk_ahead") < F.col(k))
        & (F.col("tk_ahead") + F.col("tk_in_cell") > F.col(k))
    )
    lane = F.when(edge, F.lit(-1)).otherwise(F.pmod(F.hash(F.col(spread)), F.lit(256)))
    place = F.row_number().over(W.partitionBy(*by, "tk_cell", "tk_lane").orderBy(*order))
    return (
        joined.withColumn("tk_lane", lane)
        .withColumn("tk_place", F.when(F.col("tk_lane") == -1, place))
        .withColumn(
            alias,
            F.col("tk_in_play")
            & (
                F.when(F.col("tk_lane") == -1, F.col("tk_ahead") + F.col("tk_place") <= F.col(k)).otherwise(
                    F.col("tk_ahead") + F.col("tk_in_cell") <= F.col(k)
                )
            ),
        )
        .drop("tk_in_play", "tk_cell", "tk_in_cell", "tk_ahead", "tk_lane", "tk_place")
    )


def dense_index(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Add ``idx`` (0-based) and ``group_size`` per slice, in md5-bucket then key order.

    Keys must be unique per slice, so the 4,096 hash buckets are even.
    """
    by = list(by)
    base = df.withColumn("bucket", hash_bucket(F.lit(seed), *[F.col(c) for c in keys]))
    counts = base.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    slice_window = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = slice_window.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = slice_window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = counts.select(
        *by,
        "bucket",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"),
        F.sum("c").over(whole).alias("group_size"),
    )
    inside = W.partitionBy(*by, "bucket").orderBy(*keys)
    return (
        _match(base, offsets, [*by, "bucket"])
        .withColumn("idx", F.col("start") + F.row_number().over(inside) - 1)
        .drop("bucket", "start")
    )
