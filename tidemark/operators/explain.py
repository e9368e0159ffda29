"""Coefficient summaries, permutation importance and exact contributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import dense_index
from tidemark.functions.scalars import inverse_logit
from tidemark.operators.metrics import ranking_metrics
from tidemark.operators.models import MISSING, BaseModel, apply_base_model
from tidemark.session import cut_lineage


def summarize_coefficients(rows: DataFrame) -> DataFrame:
    """Mean, spread, sign agreement and rank of coefficients over folds."""
    c = F.col("standardized_coefficient")
    folds = rows.groupBy("observation_day").agg(F.max("fold").alias("folds"))
    out = (
        rows.groupBy("observation_day", "feature", "is_missing_indicator")
        .agg(
            F.count(F.lit(1)).alias("folds_present"),
            F.avg(c).alias("mean_standardized_coefficient"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("standard_deviation_across_folds"),
            F.count_distinct(F.signum(c)).alias("signs"),
            F.min(F.abs(F.signum(c))).alias("nonzero"),
        )
        .join(folds, "observation_day")
    )
    mean = F.col("mean_standardized_coefficient")
    by_size = W.partitionBy("observation_day").orderBy(F.abs(mean).desc(), "feature")
    return out.select(
        "observation_day",
        "feature",
        "is_missing_indicator",
        "folds_present",
        "mean_standardized_coefficient",
        "standard_deviation_across_folds",
        ((F.col("folds_present") == F.col("folds")) & (F.col("signs") == 1) & (F.col("nonzero") == 1)).alias("sign_agreement"),
        F.when(mean > 0, "positive").when(mean < 0, "negative").otherwise("zero").alias("direction"),
        F.abs(mean).alias("absolute_mean_coefficient"),
        F.row_number().over(by_size).alias("absolute_coefficient_rank"),
    )


def top_coefficients(summary: DataFrame, k: int = 5) -> DataFrame:
    return summary.where(F.col("absolute_coefficient_rank") <= k)


def compare_rankings(summary: DataFrame, first_day: int, second_day: int, k: int = 5) -> DataFrame:
    """Top-k overlap and rank correlation of two days' original features."""
    original = summary.where(~F.col("is_missing_indicator"))
    rank = F.row_number().over(
        W.partitionBy("observation_day").orderBy(F.col("absolute_mean_coefficient").desc(), "feature")
    )
    ranked = original.withColumn("rank", rank)
    a = ranked.where(F.col("observation_day") == first_day).select("feature", F.col("rank").alias("ra"))
    b = ranked.where(F.col("observation_day") == second_day).select("feature", F.col("rank").alias("rb"))
    correlation = a.join(b, "feature").agg(
        F.when((F.min("ra") < F.max("ra")) & (F.min("rb") < F.max("rb")), F.corr("ra", "rb")).alias("rank_correlation")
    )
    tops = summary.where(F.col("absolute_coefficient_rank") <= k)
    shared = (
        tops.where(F.col("observation_day").isin(first_day, second_day))
        .groupBy("feature")
        .agg(F.count_distinct("observation_day").alias("d"))
        .where("d = 2")
        .agg(F.array_sort(F.collect_list("feature")).alias("top_overlap"))
    )
    one = F.lit(1)
    return correlation.withColumn("one", one).join(shared.withColumn("one", one), "one").drop("one")


def logit_parts(model: BaseModel, rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``keys``, ``label``, raw (the logit) and parts: what each input feature, missing flag included, adds to it."""
    prepared = model.pipeline.stages[0].transform(rows)
    added = {f: F.lit(0.0) for f in model.inputs}
    for i, (name, c) in enumerate(zip(model.names, model.coefficients)):
        added[name.removeprefix(MISSING)] += F.col(f"z_{i}") * F.lit(c)
    with_parts = prepared.select(*keys, label, F.array(*added.values()).alias("parts"))
    raw = F.aggregate("parts", F.lit(model.intercept), lambda total, part: total + part)
    return with_parts.select(*keys, label, raw.alias("raw"), "parts")


def _turn(seed: int, feature: str, repeat: int, block: int, rows: int) -> int:
    """How far a block's values of a feature turn: 1 to rows - 1 places, 0 for a single row."""
    if rows < 2:
        return 0
    return 1 + int(md5(f"{seed}|{feature}|{repeat}|{block}".encode()).hexdigest()[:8], 16) % (rows - 1)


_CHUNK = 16  # blocks whose shuffled scores leave a task together
_CELL_ROWS = 1 << 20  # about so many scores of one shuffle are ordered at once
_SORT_BYTES = 1 << 26  # scores that a task of the second pass reads


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by its first ``width`` columns, which are never null."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and any(batch.column(c)[0] != held[0].column(c)[0] for c in range(width)):
            yield pa.Table.from_batches(held)
            held = []
        edge = np.zeros(batch.num_rows - 1, bool)
        for c in range(width):
            edge |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        for begin, end in zip(starts, starts[1:]):
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)


def _shuffled_scores(
    by: list[str], features: list[str], repeats: int, seed: int, cells: dict[tuple, np.ndarray]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed scores of positives and negatives for each slice, shuffled feature, repeat and cell of a chunk of blocks."""
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, head = None, {}, []

        def packed() -> Iterator[pa.RecordBatch]:
            for k in range(len(features)):
                rows = [(k, r, cell, *(np.concatenate(side).tobytes() for side in held.pop((k, r, cell)))) for _, r, cell in sorted(x for x in held if x[0] == k)]
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    own = [pa.repeat(v, len(rows)) for v in head]
                    yield pa.record_batch([*own, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*by, "shuffled", "repeat", "cell", "pos", "neg"])

        for group in _runs(batches, width + 2):
            first = [group.column(c)[0] for c in range(width + 2)]
            if first[:-1] != now:
                yield from packed()
                now, head = first[:-1], first[:width]
            block, n = first[-1].as_py(), group.num_rows
            if group.column("y").null_count:
                raise ValueError("labels are 0 or 1, never null")
            y, raw = group.column("y").to_numpy() == 1, group.column("raw").to_numpy()
            values = group.column("parts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, len(features))
            edges = cells[tuple(v.as_py() for v in head)]
            for k, name in enumerate(features):
                rest = raw - values[:, k]
                for r in range(repeats):
                    score = 1 / (1 + np.exp(-(rest + np.roll(values[:, k], -_turn(seed, name, r, block, n)))))
                    cell = np.searchsorted(edges, score, side="right") if len(edges) else np.zeros(n, int)
                    for c in np.unique(cell).tolist() if len(edges) else [0]:
                        pos, neg = held.setdefault((k, r, c), ([], []))
                        pos.append(score[(cell == c) & y])
                        neg.append(score[(cell == c) & ~y])
        yield from packed()

    return run


def _precision_sums(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Average precision of each slice, shuffled feature and repeat, whose cells come from the highest scores down."""
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        positives, negatives, hits = 0, 0, 0.0

        def found() -> None:
            if now is not None:
                done.append((*(v.as_py() for v in now[:width]), now[width].as_py(), hits / positives if positives else None))

        for group in _runs(batches, width + 3):
            key = [group.column(c)[0] for c in range(width + 2)]
            if key != now:
                found()
                now, positives, negatives, hits = key, 0, 0, 0.0
            pos, neg = (
                np.sort(np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in group.column(c)])) for c in ("pos", "neg")
            )
            value, count = np.unique(pos, return_counts=True)
            above = positives + np.cumsum(count[::-1])[::-1]
            seen = above + negatives + len(neg) - np.searchsorted(neg, value, side="left")
            hits += float(np.sum(count * above / seen))
            positives, negatives = positives + len(pos), negatives + len(neg)
        found()
        if done:
            kinds = [*(v.type for v in now[: width + 1]), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], [*by, "shuffled", "average_precision"])

    return run


def permutation_from_parts(
    parts: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    label: str,
    repeats: int = 30,
    seed: int = 42,
    block_rows: int = 1024,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean drop of average precision when one feature's part of the logit is shuffled, in each slice ``by``.

    ``parts``: ``by`` (never null), ``keys`` (unique in a slice, never null), ``label``
    (0 or 1), raw and parts (one number for each of ``features``).  Rows of a slice
    get a hash-ordered index and are dealt to blocks of at most ``block_rows``; in a
    repeat the values of a feature turn within each block, which in a random order
    pairs every row with a random other one.  A shuffled logit is the old one plus a
    difference, so no row is joined or scored again.  Scores leave a chunk of blocks
    packed, eight bytes each, and a shuffle's scores meet from the highest cell down,
    so that one cell at a time is ordered.
    """
    features, by = list(features), list(by)
    columns = list(dict.fromkeys([*by, *keys, label, "raw", "parts"]))
    indexed = cut_lineage(dense_index(parts.select(*columns), keys, by, seed))
    blocks = F.ceil(F.col("group_size") / block_rows)
    block = F.pmod("idx", blocks)
    dealt = indexed.select(
        *by, F.floor(block / _CHUNK).alias("chunk_"), block.alias("block_"), F.col("idx").alias("idx_"),
        F.col(label).cast("int").alias("y"), F.col("raw").cast("double").alias("raw"), "parts",
    )
    # one row for each slice
    sizes = indexed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    large = [r for r in sizes if r.n > _CELL_ROWS]
    cells = {tuple(r[: len(by)]): np.empty(0) for r in sizes}
    if large:
        steps = max(r.n for r in large) // _CELL_ROWS
        shares = F.array(*[F.lit(k / (steps + 1)) for k in range(1, steps + 1)])
        for r in indexed.groupBy(*by).agg(F.percentile_approx("raw", shares).alias("raw")).collect():
            edges = 1 / (1 + np.exp(-np.array(r.raw or [], np.float64)))
            cells[tuple(r[: len(by)])] = np.unique(edges)
    rows = sum(r.n for r in sizes)
    chunks = sum(-(-r.n // (block_rows * _CHUNK)) for r in sizes)
    kinds = {f.name: f.dataType.simpleString() for f in parts.select(*by).schema.fields}
    head = "".join(f"`{c}` {kinds[c]}, " for c in by)
    scores = (
        dealt.repartition(max(1, 2 * chunks), *by, "chunk_")
        .sortWithinPartitions(*by, "chunk_", "block_", "idx_")
        .select(*by, "chunk_", "block_", "y", "raw", "parts")
        .mapInArrow(_shuffled_scores(by, features, repeats, seed, cells), f"{head}shuffled int, repeat int, cell int, pos binary, neg binary")
    )
    series = len(sizes) * len(features) * repeats
    tasks = max(8 * rows * len(features) * repeats // _SORT_BYTES, min(series, parts.sparkSession.sparkContext.defaultParallelism), 1)
    dropped = (
        scores.repartition(tasks, *by, "shuffled", "repeat")
        .sortWithinPartitions(*by, "shuffled", "repeat", F.desc("cell"))
        .mapInArrow(_precision_sums(by), f"{head}shuffled int, average_precision double")
    )
    # one row for each slice, feature and repeat; written, each block is shuffled once
    dropped = cut_lineage(dropped)
    one = F.lit(1).alias("one")
    whole = dealt.select(one, *by, "y", inverse_logit(F.col("raw")).alias("score"))
    baseline = ranking_metrics(whole, ["one", *by], "score", "y").select("one", *by, F.col("average_precision").alias("baseline"))
    loss = F.col("baseline") - F.col("average_precision")
    names = F.array(*[F.lit(f) for f in features])
    return (
        dropped.select("*", one)
        .join(F.broadcast(baseline), ["one", *by])  # one row for each slice
        .groupBy(*by, F.element_at(names, F.col("shuffled") + 1).alias("feature"))
        .agg(
            F.avg(loss).alias("importance_mean"),
            F.stddev_pop(loss).alias("importance_standard_deviation"),
            F.count(F.lit(1)).alias("repeats"),
        )
    )


def permutation_importance(
    model: BaseModel,
    validation: DataFrame,
    keys: Sequence[str],
    label: str,
    repeats: int = 30,
    seed: int = 42,
) -> DataFrame:
    """Mean drop of average precision when one input feature of ``model`` is shuffled."""
    return permutation_from_parts(logit_parts(model, validation, keys, label), model.inputs, keys, label, repeats, seed)


def summarize_importance(rows: DataFrame) -> DataFrame:
    v = F.col("importance_mean")
    return rows.groupBy("observation_day", "feature").agg(
        F.count(F.lit(1)).alias("folds_present"),
        F.avg(v).alias("mean_importance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("standard_deviation_across_folds"),
    )


def contributions(model: BaseModel, rows: DataFrame, keys: Sequence[str], k: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """Exact logit contributions per row with the top increasing and decreasing ones."""
    scored = apply_base_model(model, rows, "model_output", "decision_function")
    prepared = model.pipeline.stages[0].transform(scored)
    parts = F.array(
        *[
            F.struct(
                (F.col(f"z_{i}") * F.lit(c)).alias("contribution"),
                F.lit(name).alias("feature"),
                F.col(f"z_{i}").alias("standardized_value"),
                F.lit(c).alias("coefficient"),
            )
            for i, (name, c) in enumerate(zip(model.names, model.coefficients))
        ]
    )
    total = F.aggregate("parts", F.lit(model.intercept), lambda acc, x: acc + x.contribution)
    rising = F.filter("parts", lambda x: x.contribution > 0)
    falling = F.filter("parts", lambda x: x.contribution < 0)
    return prepared.withColumn("parts", parts).select(
        *keys,
        "model_output",
        F.lit(model.intercept).alias("intercept"),
        "decision_function",
        total.alias("intercept_plus_contributions"),
        (F.abs(total - F.col("decision_function")) <= tolerance).alias("contribution_sum_verified"),
        F.slice(F.reverse(F.array_sort(rising)), 1, k).alias("top_increasing"),
        F.slice(F.array_sort(falling), 1, k).alias("top_decreasing"),
    )
