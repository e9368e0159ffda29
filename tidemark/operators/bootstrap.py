"""Cluster bootstrap by weights: every unit draws a Poisson(1) weight for each sample.

A weight is an integer hash of the unit and the sample, so it is the same in
every slice, in every task and in every SQL engine, and no table of draws
exists.  A task turns a batch of units into a matrix of weights and multiplies
it with their statistics; what it passes on is one sum for each slice and
sample, however many units it saw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import value_cells
from tidemark.functions.scalars import ratio
from tidemark.session import cut_lineage

#: Fixed numbers of the hash: a step between samples, two multipliers.
STEP, MULTIPLY = 2654435769, (2146121005, 2221713035)
#: A weight is the number of these limits that a 32-bit hash reaches.
LIMITS = tuple(
    math.floor(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(upto + 1))) for upto in range(11)
)
_LIMITS = np.array(LIMITS, np.uint32)
# the upper half of a hash tells its weight, but for the eleven values that hold a limit
_BY_TOP = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16), side="right").astype(np.float64)
_UNSURE = np.isin(np.arange(1 << 16), _LIMITS >> np.uint32(16))
_HELD = 4_000_000  # sums that a task keeps before it passes them on


def unit_seed(keys: Sequence[str], seed: int) -> Column:
    """32 bits of md5 of the seed and the unit's keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weights(units: np.ndarray, samples: int) -> np.ndarray:
    """Weight of each unit (a row) in each sample (a column)."""
    step = (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)
    x = units.astype(np.uint32)[:, None] + step[None, :]
    x ^= x >> np.uint32(16)
    x *= np.uint32(MULTIPLY[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MULTIPLY[1])
    x ^= x >> np.uint32(16)
    top = x >> np.uint32(16)
    out = _BY_TOP[top]
    unsure = np.flatnonzero(_UNSURE[top])
    out.flat[unsure] = np.searchsorted(_LIMITS, x.flat[unsure], side="right")
    return out


def _pieces(n: int, samples: int) -> Iterator[slice]:
    step = max(1, _HELD // (2 * samples))
    return (slice(at, at + step) for at in range(0, n, step))


def weighted_sums(
    stats: DataFrame, keys: Sequence[str], by: Sequence[str], columns: Sequence[str], samples: int, seed: int = 42
) -> DataFrame:
    """``by``, sample and the weighted sum of each of ``columns`` (doubles), for every sample of every slice.

    ``stats`` holds one row or more for each unit (``keys``) and slice; null
    statistics count as zero.  A slice without units has no rows; a sample in
    which every unit weighs zero has sums of zero.
    """
    by, columns = list(by), list(columns)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*by).schema.fields]
    rows = stats.select(
        *by,
        F.xxhash64(*(by or [F.lit(0)])).alias("slice_"),
        unit_seed(keys, seed).alias("unit_"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"stat_{k}") for k, c in enumerate(columns)],
    )
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        slices: dict[int, list] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                fixed = [pa.repeat(v, samples) for v in slices[key]]
                values = [pa.array(total[:, k]) for k in range(total.shape[1])]
                yield pa.record_batch([*fixed, pa.array(np.arange(samples, dtype=np.int32)), *values], names)
            sums.clear()
            slices.clear()

        for batch in batches:
            names = [*batch.schema.names[:width], "sample", *columns]
            code, unit = batch.column(width).to_numpy(), batch.column(width + 1).to_numpy()
            values = np.column_stack([batch.column(width + 2 + k).to_numpy() for k in range(len(columns))])
            order = np.argsort(code, kind="stable")
            found, first = np.unique(code[order], return_index=True)
            for key, mine in zip(found.tolist(), np.split(order, first[1:])):
                if key not in sums:
                    sums[key] = np.zeros((samples, len(columns)))
                    slices[key] = [batch.column(k)[int(mine[0])] for k in range(width)]
                for some in _pieces(len(mine), samples):
                    sums[key] += weights(unit[mine[some]], samples).T @ values[mine[some]]
                if len(sums) * samples * len(columns) > _HELD:
                    yield from close()
        yield from close()

    schema = ", ".join([*kinds, "sample int", *[f"`{c}` double" for c in columns]])
    return rows.mapInArrow(run, schema).groupBy(*by, "sample").agg(*[F.sum(c).alias(c) for c in columns])


def _score_sums(group: pa.Table, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a cell from the highest down, and weighted positives and negatives [score, sample]."""
    score, y = group.column("score").to_numpy(), group.column("y").to_numpy()
    unit = group.column("unit_").fill_null(-1).to_numpy()
    scores, place = np.unique(-score, return_inverse=True)
    out = np.zeros((2, len(scores), samples))
    rows = np.flatnonzero(unit >= 0)
    rows = rows[np.argsort(place[rows], kind="stable")]
    for some in _pieces(len(rows), samples):
        part = rows[some]
        w = weights(unit[part], samples)
        at, first = np.unique(place[part], return_index=True)
        positive = (y[part] == 1)[:, None] * w
        out[0, at] += np.add.reduceat(positive, first, axis=0)
        out[1, at] += np.add.reduceat(w - positive, first, axis=0)
    for k in np.flatnonzero(unit < 0).tolist():
        out[0, place[k]] += group.column("pos_")[k].as_py()
        out[1, place[k]] += group.column("neg_")[k].as_py()
    return -scores, out[0], out[1]


def ranking_samples(
    rows: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    score: str,
    label: str,
    threshold: float,
    samples: int,
    seed: int = 42,
    hot_rows: int = 65_536,
) -> DataFrame:
    """Confusion counts, ROC AUC and average precision of every sample of every slice.

    Columns: ``by``, sample, tp, fp, fn, tn, roc_auc and average_precision (null
    unless the sample holds both classes).  Rows are dealt by cells of the score:
    one pass sums each cell, totals are cumulated over cells, and a second pass
    ranks within cells.  Scores shared by more than ``hot_rows`` rows are summed
    before they meet their cell.  Null scores and labels are left out; slice
    columns are never null.
    """
    by = list(by)
    base = rows.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"), unit_seed(keys, seed).alias("unit_"))
    base = cut_lineage(base.where("score IS NOT NULL AND y IS NOT NULL"))
    counts = base.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("rows_"))
    cells = value_cells(counts, by, "score").select(
        *by, "score", F.col("cell.grid").alias("grid"), F.col("cell.part").alias("part"), (F.col("rows_") > hot_rows).alias("hot_")
    )
    cells = cut_lineage(cells)
    dealt = cut_lineage(base.join(cells, [*by, "score"]))
    hot = dealt.where("hot_").select(*by, "score", "grid", "part", "unit_", F.col("y").alias("pos"), (1 - F.col("y")).alias("neg"))
    cell = [*by, "grid", "part"]
    summed = weighted_seed_sums(hot, [*cell, "score"], ["pos", "neg"], samples)
    none = F.lit(None).cast("array<double>")
    narrow = dealt.where("NOT hot_").select(*cell, "score", "y", "unit_", none.alias("pos_"), none.alias("neg_")).unionByName(
        summed.select(*cell, "score", F.lit(-1).alias("y"), F.lit(None).cast("long").alias("unit_"), "pos_", "neg_")
    )
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in cell)

    def first_of(group: pa.Table) -> dict:
        return {c: group.column(c).slice(0, 1).combine_chunks() for c in cell}

    def totals(group: pa.Table) -> pa.Table:
        scores, pos, neg = _score_sums(group, samples)
        over = scores >= threshold
        arrays = {"pos": pos.sum(0), "neg": neg.sum(0), "tp": pos[over].sum(0), "fp": neg[over].sum(0)}
        return pa.table(first_of(group) | {c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in arrays.items()})

    sums = narrow.groupBy(*cell).applyInArrow(totals, f"{head}, pos array<double>, neg array<double>, tp array<double>, fp array<double>")
    wide = cut_lineage(sums.select(*cell, F.posexplode(F.arrays_zip("pos", "neg", "tp", "fp")).alias("sample", "v")).select(*cell, "sample", "v.*"))
    above = W.partitionBy(*by, "sample").orderBy(F.desc("grid"), F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    offsets = wide.select(
        *cell, "sample", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("pos", "neg")]
    )
    # one pair of numbers for each sample, put in order again
    entries = F.array_sort(F.collect_list(F.struct("sample", "pos", "neg")))
    offsets = offsets.groupBy(*cell).agg(entries.alias("e")).select(*cell, F.col("e.pos").alias("pos"), F.col("e.neg").alias("neg"))

    def ranked(group: pa.Table, before: pa.Table) -> pa.Table:
        _, pos, neg = _score_sums(group, samples)
        over_pos = np.array(before.column("pos")[0].as_py()) + np.cumsum(pos, axis=0)
        over_neg = np.array(before.column("neg")[0].as_py()) + np.cumsum(neg, axis=0)
        seen = over_pos + over_neg
        precision = np.divide(over_pos, seen, out=np.zeros_like(seen), where=seen > 0)
        # pairs that the negatives above, and half of those beside, take from a positive
        arrays = {"lost": (pos * (over_neg - neg / 2)).sum(0), "ap": (pos * precision).sum(0)}
        return pa.table(first_of(group) | {c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in arrays.items()})

    parts = narrow.groupBy(*cell).cogroup(offsets.groupBy(*cell)).applyInArrow(ranked, f"{head}, lost array<double>, ap array<double>")
    parts = parts.select(*by, F.posexplode(F.arrays_zip("lost", "ap")).alias("sample", "v")).select(*by, "sample", "v.*")
    parts = parts.groupBy(*by, "sample").agg(F.sum("lost").alias("lost"), F.sum("ap").alias("ap"))
    whole = wide.groupBy(*by, "sample").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return whole.join(parts, [*by, "sample"]).select(
        *by,
        "sample",
        "tp",
        "fp",
        (F.col("pos") - F.col("tp")).alias("fn"),
        (F.col("neg") - F.col("fp")).alias("tn"),
        F.when(both, 1 - F.col("lost") / (F.col("pos") * F.col("neg"))).alias("roc_auc"),
        F.when(both, ratio(F.col("ap"), F.col("pos"))).alias("average_precision"),
    )


def weighted_seed_sums(rows: DataFrame, by: Sequence[str], columns: Sequence[str], samples: int) -> DataFrame:
    """``by`` and an array over samples for each of ``columns`` (named ``*_``), from rows with their ``unit_`` seed."""
    by, columns = list(by), list(columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code = batch.column(len(by)).to_numpy()
            unit = batch.column(len(by) + 1).to_numpy()
            values = np.column_stack([batch.column(len(by) + 2 + k).to_numpy() for k in range(len(columns))]).astype(np.float64)
            found, first, place = np.unique(code, return_index=True, return_inverse=True)
            for k, at in enumerate(first.tolist()):
                mine = np.flatnonzero(place == k)
                total = np.zeros((samples, len(columns)))
                for some in _pieces(len(mine), samples):
                    total += weights(unit[mine[some]], samples).T @ values[mine[some]]
                fixed = [pa.repeat(table.column(c)[at], samples) for c in range(len(by))]
                arrays = [pa.array(total[:, c]) for c in range(len(columns))]
                yield pa.record_batch([*fixed, pa.array(np.arange(samples, dtype=np.int32)), *arrays], [*by, "sample", *columns])

    slim = rows.select(*by, F.xxhash64(*by).alias("slice_"), "unit_", *columns)
    sums = slim.mapInArrow(run, f"{kinds}, sample int, {', '.join(f'`{c}` double' for c in columns)}")
    sums = sums.groupBy(*by, "sample").agg(*[F.sum(c).alias(c) for c in columns])
    entries = F.array_sort(F.collect_list(F.struct("sample", *columns)))
    return sums.groupBy(*by).agg(entries.alias("e_")).select(*by, *[F.col(f"e_.{c}").alias(f"{c}_") for c in columns])
