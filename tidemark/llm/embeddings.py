"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one row with a count.  Cells are fitted on a bounded sample
with Spark ML's k-means under cosine distance; every vector joins its
``probes`` nearest cells.  A pair that shares several cells counts in the lowest
of them.  A cell above ``block_rows`` rows is cut into blocks, and each pair of
blocks is multiplied in a task of its own, so a hot cell needs no large group.
Tasks pass on one count for each vector and the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, merge_labels
from tidemark.llm.storage import written

_TILE = 512  # rows multiplied at once


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles, scaled to a largest component of 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.abs(flat).max(axis=1, keepdims=True)


def _cells(vectors: DataFrame, n: int, rows_per_cell: int, max_cells: int, sample_per_cell: int, seed: int):
    """Unit centres (cells x dims) by spherical k-means over a sample chosen by hash."""
    k = min(max_cells, max(1, n // rows_per_cell))
    if k == 1:
        return None
    share = min(1.0, sample_per_cell * k / n)
    picked = vectors.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    points = picked.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, distanceMeasure="cosine", maxIter=10, initSteps=2, seed=seed).fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def link_embeddings(
    vectors: DataFrame,
    threshold: float = 0.9,
    probes: int = 3,
    rows_per_cell: int = 512,
    max_cells: int = 2048,
    sample_per_cell: int = 40,
    block_rows: int = 4096,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors found in one cell link at a cosine of at least ``threshold`` in
    double precision.  ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks it.  The
    k-means sample has about ``sample_per_cell`` times the number of cells rows,
    at most ``sample_per_cell * max_cells``; every vector is indexed.  Vectors
    of a length other than the commonest share one cell for each length.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing and keep themselves.  A null id has 0 links, a null
    component and is not kept.  Equal rows are linked; equal ids count as
    separate vectors.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    distinct = written(
        rows.where("sound")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dims", F.size("embedding")),
        "distinct-vectors",
    )
    lengths = distinct.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims, n = (lengths["dims"], lengths["count"]) if lengths else (0, 0)
    centres = _cells(distinct.where(F.col("dims") == dims), n, rows_per_cell, max_cells, sample_per_cell, seed) if n else None

    def assign(batches):
        for batch in batches:
            width = batch.column("dims").to_numpy()
            usual = width == dims
            cells: list = [[-int(w)] for w in width]
            if centres is not None and usual.any():
                x = _matrix(batch.column("embedding").filter(pa.array(usual)))
                near = x @ centres.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                for at, row in zip(np.flatnonzero(usual), np.sort(best, axis=1).tolist()):
                    cells[at] = row
            yield pa.record_batch(
                [*(batch.column(c) for c in ("node", "copies", "embedding")), pa.array(cells, pa.list_(pa.int32()))],
                ["node", "copies", "embedding", "cells"],
            )

    kind = distinct.schema["embedding"].dataType.simpleString()
    placed = written(
        distinct.mapInArrow(assign, f"node long, copies long, embedding {kind}, cells array<int>"), "placed-vectors"
    )
    dealt = placed.withColumn("cell", F.explode("cells"))
    # one row for each cell: at most max_cells and one for each other length
    blocks = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = dealt.join(blocks, "cell").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )

    def compare(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        copies = table["copies"].to_numpy()
        x = _matrix(table["embedding"].combine_chunks())
        cells = table["cells"].to_pylist()
        cell = table["cell"][0].as_py()
        width = max(map(len, cells))
        of = np.array([c + [-(2**31)] * (width - len(c)) for c in cells], np.int64)
        norm = np.sqrt((x * x).sum(axis=1))
        block = table["block"].to_numpy()
        low, high = block.min(), block.max()
        crossing = table["low"][0].as_py() != table["high"][0].as_py()
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high) if crossing else left
        counts, label = np.zeros(len(node), np.int64), np.arange(len(node))
        if crossing and low == high:  # the other block of the pair is empty
            left = left[:0]
        for at in range(0, len(left), _TILE):
            rows_ = left[at : at + _TILE]
            for to in range(0 if crossing else at, len(right), _TILE * 4):
                cols = right[to : to + _TILE * 4]
                near = (x[rows_] @ x[cols].T) / np.outer(norm[rows_], norm[cols])
                i, j = np.nonzero(near >= threshold)
                i, j = rows_[i], cols[j]
                if not crossing:
                    once = i < j
                    i, j = i[once], j[once]
                if cell >= 0 and len(i):
                    # the lowest cell that both have must be this one
                    both = (of[i][:, :, None] == of[j][:, None, :]) & (of[i][:, :, None] >= 0)
                    shared = np.where(both.any(axis=2), of[i], np.int64(2**31)).min(axis=1)
                    i, j = i[shared == cell], j[shared == cell]
                if len(i):
                    np.add.at(counts, i, copies[j])
                    np.add.at(counts, j, copies[i])
                    label = merge_labels(label, i, j)
        some = counts > 0
        return pa.table(
            {"node": node[some], "links": counts[some], "hub": node[label[some]]},
        )

    found = written(
        pairs.withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .groupBy("cell", "low", "high")
        .applyInArrow(compare, "node long, links long, hub long"),
        "vector-links",
    )
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = (
        distinct.join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            F.col("embedding").alias("_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("root", "node").alias("_root"),
        )
    )
    # unsound vectors must not meet a sound one: their join key is null
    return (
        rows.withColumn("_key", F.when(F.col("sound"), F.col("embedding")))
        .join(groups, F.col("_key") == F.col("_embedding"), "left")
        .select(
            "vec_id",
            F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("_root", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
