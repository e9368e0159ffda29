"""Connected components of an edge table by alternating star steps.

Edges never reach the driver: each round is two aggregations by node and two
joins, written to the shared folder.  A hub's edges are a skewed join side that
adaptive execution can split, and its minimum is combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop_written, written


def _signature(edges: DataFrame) -> tuple:
    # sums of 31 bits each cannot overflow a long at any realistic edge count
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("child", "parent").bitwiseAND(0x7FFFFFFF)).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is not a root itself.

    The root is the smallest node reachable.
    Null ends and self loops are ignored; an empty edge table gives an empty
    result.  Repeated edges count once.
    """
    stars = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .distinct(),
        "stars",
    )
    before = _signature(stars)
    if before[0] == 0:
        return stars.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    while True:
        # large star: every larger neighbour moves to the node's smallest neighbour
        both = stars.select(
            F.explode(
                F.array(
                    F.struct(F.col("child").alias("u"), F.col("parent").alias("v")),
                    F.struct(F.col("parent").alias("u"), F.col("child").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            large.join(low, "u")
            .select(
                F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("child"),
                F.col("m").alias("parent"),
            )
            .unionByName(low.select(F.col("u").alias("child"), F.col("m").alias("parent")))
            .distinct()
        )
        after_stars = written(moved, "small-star")
        after = _signature(after_stars)
        drop_written(large)
        drop_written(stars)
        stars = after_stars
        if after == before:
            return stars.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        before = after


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of a partial forest after adding the links (a, b); the lowest label wins."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of links that span every component, lightest first."""
    label, kept = np.arange(n), []
    for w in np.unique(weight):
        at = np.flatnonzero(weight == w)
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if len(at) == 0:
            continue
        low, high = np.minimum(x, y), np.maximum(x, y)
        _, first = np.unique(low * n + high, return_index=True)
        kept.append(at[first])
        label = merge_labels(label, low[first], high[first])
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)
