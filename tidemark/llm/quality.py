"""A quality classifier on graded ratings: ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - w . x), with one weight vector w over
hashed words for all grades and ordered thresholds.  x marks which hashed
features a text has: its words and their beginnings, which say something of
words too rare to be learned, and bins of its length, of the shares of capital,
repeated and distinct words and of the share of each sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from tidemark.llm.storage import free_names

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…"
_SIGNS = "!#$%&*+<=>@[\\]^_`{|}~"
_BEGINNINGS = (4, 5, 6)


def _bucket(feature: str, buckets: int) -> int:
    return xxh32_intdigest(feature, 11) % buckets


def hashed_features(text: str | None, buckets: int) -> np.ndarray:
    """Sorted distinct buckets of a whole text; one without words has a bucket of its own."""
    text = text or ""
    words = text.split()
    if not words:
        return np.array([_bucket("no words", buckets)])
    n = len(words)
    bare = {w.strip(_EDGES) for w in set(text.lower().split())}
    begun = {w[:k] for k in _BEGINNINGS for w in bare if len(w) >= k}
    found = [_bucket("w" + w, buckets) for w in bare] + [_bucket("b" + w, buckets) for w in begun]
    shares = (
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
    )
    found += [_bucket(f"share {k} {int(min(s, 0.999) * 20)}", buckets) for k, s in enumerate(shares)]
    for sign in _SIGNS:
        count = text.count(sign)
        if count:
            found.append(_bucket(f"sign {sign} {int(np.log2(count / len(text)))}", buckets))
    found.append(_bucket(f"length {int(np.log2(n))}", buckets))
    return np.unique(np.array(found))


class OrdinalModel:
    """Weights over hashed features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, one row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def telling_buckets(
    index: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, buckets: int, least_z: float
) -> np.ndarray:
    """Buckets whose presence differs between grades, by the z of two proportions.

    Each grade is compared with all others; at least 3 documents must have the bucket.
    """
    held, n = np.bincount(index, minlength=buckets), len(grades)
    best = np.zeros(buckets)
    for grade in range(n_grades):
        mine = grades == grade
        a = mine.sum()
        if a in (0, n):
            continue
        have = np.bincount(index[mine[row]], minlength=buckets)
        pooled = held / n
        spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / a + 1 / (n - a)))
        best = np.maximum(best, np.abs(have / a - (held - have) / (n - a)) / spread)
    return np.flatnonzero((held >= 3) & (best >= least_z))


def fit_ordinal(
    features: list[np.ndarray],
    grades: np.ndarray,
    n_grades: int,
    buckets: int,
    penalty: float = 1e-4,
    least_z: float = 6.0,
    balance: float = 0.25,
    rounds: int = 300,
) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty by Adam.

    A row weighs its grade's count to the power ``-balance``: 0 is plain maximum
    likelihood, 1 gives all grades the same total weight.  Only ``telling_buckets``
    get a weight: thousands of words that say nothing would otherwise add up to
    noise in long texts.
    """
    size, index = np.fromiter(map(len, features), np.int64, len(features)), np.concatenate(features)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    used = telling_buckets(index, row, grades, n_grades, buckets, least_z)
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    index = place[index]
    told = index >= 0
    index, row = index[told], row[told]
    all_buckets, buckets = buckets, len(used)
    count = np.bincount(grades, minlength=n_grades).astype(float)
    weight = np.maximum(count, 1)[grades] ** -balance
    weight /= weight.sum()
    w, first = np.zeros(buckets), -1.0
    gaps = np.zeros(max(0, n_grades - 2))
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(len(grades))
    for step in range(1, rounds + 1):
        w, first, gaps = params[:buckets], params[buckets], params[buckets + 1 :]
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(row, w[index], len(size))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
        below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        high, low = below[rows, grades + 1], below[rows, grades]
        p = np.maximum(high - low, 1e-12)
        pull = weight * (high + low - 1)  # gradient of the log likelihood by the score
        grad = np.empty_like(params)
        grad[:buckets] = -np.bincount(index, pull[row], buckets) + penalty * w
        by_cut = np.zeros(len(cuts))
        up, down = weight * high * (1 - high) / p, -weight * low * (1 - low) / p
        np.add.at(by_cut, grades[grades < n_grades - 1], up[grades < n_grades - 1])
        np.add.at(by_cut, grades[grades > 0] - 1, down[grades > 0])
        grad[buckets] = -by_cut.sum()
        grad[buckets + 1 :] = -np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(gaps)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.05 * (1 - step / (rounds + 1))
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, first, gaps = params[:buckets], params[buckets], params[buckets + 1 :]
    weights = np.zeros(all_buckets)
    weights[used] = w
    return OrdinalModel(weights, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def train_quality(
    docs: DataFrame,
    ratings: DataFrame,
    n_grades: int = 3,
    buckets: int = 1 << 20,
    sample_rows: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
) -> OrdinalModel:
    """Fit on about ``sample_rows`` rated documents chosen by a hash of their id.

    Only hashed features of the sample reach the driver.  Ratings outside
    0..n_grades-1, null ratings and ids without a document are left out; with no
    rating left every document gets even odds.  Repeated ratings and repeated rows
    of a document count once, so that they cannot widen the sample.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1)).select(
        F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade")
    ).distinct()
    share = min(1.0, sample_rows / max(1, rated.count()))
    picked = rated.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed_features(t, buckets).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "grade", "found"])

    texts = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(picked), F.col("_of") == F.col("_id")).select("_id", "_grade", "_text")
    schema = T.StructType().add("id", rated.schema["_id"].dataType).add("grade", T.IntegerType()).add("found", T.BinaryType())
    rows = sample.mapInArrow(run, schema).distinct().orderBy(F.xxhash64("found"), "grade").toArrow()
    if rows.num_rows == 0:
        return OrdinalModel(np.zeros(buckets), np.zeros(n_grades - 1))
    features = [np.frombuffer(b, np.int32) for b in rows["found"].to_pylist()]
    return fit_ordinal(features, rows["grade"].to_numpy().astype(np.int64), n_grades, buckets)


def score_quality(
    docs: DataFrame,
    model: OrdinalModel,
    least_grade: int,
    min_probability: float = 0.5,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and selected (replaced if there).

    ``tail_probability`` is P(grade >= least_grade); a document is selected from
    ``min_probability`` on.  Null and empty texts are scored as texts without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = "expected_grade double, tail_probability double"

    @F.pandas_udf(schema)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value
        fitted = OrdinalModel(weights, thresholds)
        for series in texts:
            tails = fitted.tails(np.array([weights[hashed_features(t, len(weights))].sum() for t in series]))
            yield pd.DataFrame(
                {
                    "expected_grade": tails.sum(axis=1),
                    "tail_probability": tails[:, least_grade - 1] if least_grade > 0 else 1.0,
                }
            )

    docs = docs.drop("expected_grade", "tail_probability", "selected")
    (both,) = free_names(docs, "_score")
    return (
        docs.withColumn(both, score(F.col(text_col)))
        .withColumns(
            {
                "expected_grade": F.col(both)["expected_grade"],
                "tail_probability": F.col(both)["tail_probability"],
            }
        )
        .withColumn("selected", F.col("tail_probability") >= min_probability)
        .drop(both)
    )
