"""Many logistic models over one table, fitted together.

A row may train any number of models: it carries an array with 1 for each model
it trains and 0 for the others.  Counts, moments and medians of all models come
from a few scans, and so does every Newton step; a task passes on one sum for
each model and pair of columns, whatever its number of rows.  The models are
those of ``models.fit_base_model``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranking import set_quantiles
from tidemark.functions.scalars import inverse_logit
from tidemark.schema import check_feature_names
from tidemark.session import written

MEMBER = "fit_member"
_Y = "fit_label"


def _members(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(MEMBER).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)


def _known(batch: pa.RecordBatch, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values with zero for null, and 1 where a value is known."""
    columns = [batch.column(f) for f in features]
    known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]).astype(float)
    return np.column_stack([c.fill_null(0.0).to_numpy() for c in columns]), known


def _design(batch: pa.RecordBatch, features: Sequence[str], centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Ones, centred values (zero for null) and missing flags."""
    x, known = _known(batch, features)
    return np.hstack([np.ones((len(x), 1)), known * (x - centre) / scale, 1.0 - known])


def _summed(rows: DataFrame, models: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part``, which gives one line of numbers for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(batch)
                total = here if total is None else total + here
        if total is not None:
            k, slot = np.indices(total.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.ravel()), pa.array(slot.ravel()), pa.array(total.ravel())], ["k", "slot", "value"]
            )

    sums = rows.mapInArrow(run, "k int, slot int, value double").groupBy("k", "slot").agg(F.sum("value").alias("value"))
    found = sums.collect()
    out = np.zeros((models, 1 + max((r.slot for r in found), default=-1)))
    for r in found:
        out[r.k, r.slot] = r.value
    return out


@dataclass(frozen=True)
class Fits:
    """Fitted models as one matrix over ones, centred values and missing flags."""

    features: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # a column for each model

    def logits(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and the array ``logits``, one for each model."""
        features, centre, scale, weights = self.features, self.centre, self.scale, self.weights
        keep = list(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                plain = batch.select([n for n in names if n.startswith("fit_x")]).rename_columns(list(features))
                out = _design(plain, features, centre, scale) @ weights
                ends = np.arange(0, out.size + 1, weights.shape[1], dtype=np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, "logits"])

        given = rows.select(*keep, *[F.col(f).cast("double").alias(f"fit_x{i}") for i, f in enumerate(features)])
        schema = given.select(*keep).schema.add("logits", T.ArrayType(T.DoubleType()))
        return given.mapInArrow(run, schema)


def _transforms(models, features, centre, scale, sums, medians) -> list[np.ndarray]:
    """For each model the matrix from its standardised features to the shared columns."""
    d = len(features)
    out = []
    for k, chosen in enumerate(models):
        n, known = sums[k, 0], sums[k, 2 : 2 + d]
        first, second = sums[k, 2 + d : 2 + 2 * d], sums[k, 2 + 2 * d :]
        columns = [np.eye(1, 1 + 2 * d)[0]]

        def add(on: dict[int, float], mean: float, variance: float) -> None:
            size = variance**0.5 if variance > 0 else 1.0
            column = np.zeros(1 + 2 * d)
            column[0] = -mean / size
            for slot, value in on.items():
                column[slot] += value / size
            columns.append(column)

        places = [features.index(f) for f in chosen]
        for j in places:
            if known[j] == 0:
                continue
            # in units of the shared scale, from the shared centre
            mean = first[j] / known[j]
            spread = max(second[j] / known[j] - mean * mean, 0.0)
            if spread < 1e-13 * max(1.0, mean * mean):
                spread = 0.0
            gap, median = n - known[j], (medians[k, features[j]] - centre[j]) / scale[j]
            variance = (spread * known[j] + known[j] * gap / n * (mean - median) ** 2) / n
            # a constant keeps its own unit, as its size is taken as 1
            unit = 1.0 if variance > 0 else scale[j]
            filled = (mean * known[j] + median * gap) / n
            add({1 + j: unit, 1 + d + j: median * unit}, filled * unit, variance)
        for j in places:
            share = (n - known[j]) / n
            if share > 0:
                add({1 + d + j: 1.0}, share, share * (1 - share))
        out.append(np.column_stack(columns))
    return out


def _newton(loss: Callable[[np.ndarray], tuple], transforms: list[np.ndarray], passes: int = 100) -> np.ndarray:
    """Minimise each model's weighted loss plus half its squared coefficients; intercepts are free.

    ``loss`` gives values, gradients and Hessians of all models in shared columns
    in one scan.  Steps that lower a model's objective too little are halved.
    """
    count = len(transforms)
    at = [np.zeros(t.shape[1]) for t in transforms]
    best: list = [None] * count  # objective, slope along the step, and the step, of the last accepted point
    size, done = [1.0] * count, [False] * count

    def trial(k: int) -> np.ndarray:
        return at[k] if best[k] is None or done[k] else at[k] + size[k] * best[k][2]

    for _ in range(passes):
        points = [trial(k) for k in range(count)]
        if all(done):
            break
        values, gradients, hessians = loss(np.column_stack([t @ p for t, p in zip(transforms, points)]))
        for k, (t, point) in enumerate(zip(transforms, points)):
            if done[k]:
                continue
            ridge = np.ones(len(point))
            ridge[0] = 0.0
            value = values[k] + 0.5 * (ridge * point) @ point
            if best[k] is not None and not value <= best[k][0] + 1e-4 * size[k] * best[k][1] + 1e-12 * abs(value):
                size[k] /= 2
                continue
            gradient = t.T @ gradients[k] + ridge * point
            step = -np.linalg.solve(t.T @ hessians[k] @ t + np.diag(ridge), gradient)
            at[k], best[k], size[k] = point, (value, gradient @ step, step), 1.0
            if -gradient @ step <= 1e-12 * max(1.0, value):
                at[k], done[k] = point + step, True
    if not all(done):
        raise RuntimeError(f"{done.count(False)} of {count} models did not converge")
    return np.column_stack([t @ p for t, p in zip(transforms, at)])


def fit_models(rows: DataFrame, models: Sequence[Sequence[str]], label: str) -> Fits:
    """One model for each list of features in ``models``; ``fit_member`` says which rows train it.

    Median imputation with missing flags, standardising, balanced classes and a
    unit penalty on summed losses, as in ``models.fit_base_model``.  Every scan
    reads ``rows`` again, so it should be a written table.
    """
    features = list(dict.fromkeys(f for chosen in models for f in chosen))
    for chosen in models:
        check_feature_names(list(chosen))
    count, d = len(models), len(features)
    data = written(
        rows.select(
            F.col(label).cast("double").alias(_Y),
            F.col(MEMBER).cast("array<tinyint>").alias(MEMBER),
            *[F.col(f).cast("double").alias(f) for f in features],
        ),
        "fits",
    )
    whole = data.agg(
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    centre = np.array(whole[:d])
    scale = np.array([s if s > 0 else 1.0 for s in whole[d:]])

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        member, y = _members(batch).T, batch.column(_Y).to_numpy()
        x, known = _known(batch, features)
        z = known * (x - centre) / scale
        return np.hstack([member.sum(1, keepdims=True), (member @ y)[:, None], member @ known, member @ z, member @ (z * z)])

    sums = _summed(data, count, moments)
    if sums.shape[1] == 0 or any(s[1] in (0, s[0]) for s in sums):
        raise ValueError("training rows hold one class only")
    long = data.select(
        MEMBER,
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])).alias("x"),
    ).select(MEMBER, "x.*")
    medians = {
        (r.member, r.feature): r.quantiles[0]
        for r in set_quantiles(long, ["feature"], "value", MEMBER, count, (0.5,)).collect()
    }
    transforms = _transforms(models, features, centre, scale, sums, medians)
    rate = np.column_stack([sums[:, 0] / (2 * (sums[:, 0] - sums[:, 1])), sums[:, 0] / (2 * sums[:, 1])])
    p = 1 + 2 * d
    one, other = np.triu_indices(p)

    def loss(weights: np.ndarray) -> tuple:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            y = batch.column(_Y).to_numpy()
            design = _design(batch, features, centre, scale)
            weight = _members(batch) * np.where(y[:, None] == 1, rate[:, 1], rate[:, 0])
            logit = design @ weights
            tail = np.exp(-np.abs(logit))
            chance = np.where(logit >= 0, 1.0, tail) / (1.0 + tail)
            value = weight * (np.maximum(logit, 0.0) + np.log1p(tail) - y[:, None] * logit)
            curve = weight * tail / (1.0 + tail) ** 2
            return np.hstack(
                [
                    value.sum(0)[:, None],
                    (weight * (chance - y[:, None])).T @ design,
                    curve.T @ (design[:, one] * design[:, other]),
                ]
            )

        found = _summed(data, count, part)
        hessians = np.zeros((count, p, p))
        hessians[:, one, other] = found[:, 1 + p :]
        hessians[:, other, one] = found[:, 1 + p :]
        return found[:, 0], found[:, 1 : 1 + p], hessians

    return Fits(tuple(features), centre, scale, _newton(loss, transforms))


def fold_scores(
    rows: DataFrame, folds: DataFrame, count: int, groups: dict[str, Sequence[str]], label: str, keep: Sequence[str]
) -> DataFrame:
    """Every row once for each feature group, scored by a model that never saw its entity.

    ``keep`` columns, fold, model (the group's name), logit and score.
    """
    assigned = written(rows.join(folds, "entity"), "folds")
    models = [f for f in groups.values() for _ in range(count)]
    trains = F.array(*[(F.col("fold") != f).cast("tinyint") for _ in groups for f in range(1, count + 1)])
    fits = fit_models(assigned.withColumn(MEMBER, trains), models, label)
    scored = fits.logits(assigned, [*keep, "fold"])
    entries = F.array(
        *[F.struct(F.lit(g).alias("model"), F.element_at("logits", F.lit(i * count) + F.col("fold")).alias("logit")) for i, g in enumerate(groups)]
    )
    out = scored.select(*keep, "fold", F.explode(entries).alias("e")).select(*keep, "fold", "e.*")
    return out.withColumn("score", inverse_logit(F.col("logit")))
