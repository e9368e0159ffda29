"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns.  Prefixes are named by sums of
turn hashes, so a conversation of any length is named from block sums and never
gathered.  Every node gives an enter and an exit arc; an arc names the next one
on the tour.  The list of arcs is ranked by contraction: neighbours on the tour
that lie in one batch of a task are joined there, then coins decide which arcs
join the one before them, a quarter in each round, until a bounded rest is
ranked in one task; arcs that were joined get their rank back in reverse order.
Subtree sums are differences of prefix sums at the exit and enter positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.storage import drop_written, written

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SUMS = ("s1", "s2", "s3", "s4")


def ordinals(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``ordinal``, the row's number from 1 within ``by`` in the order of ``order``, nulls first.

    Rows are dealt by range of both, so a large group is numbered by many tasks;
    only its counts for each range meet.  Columns ``range_`` and ``row_`` are taken.
    """
    rows = written(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumns({"range_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}),
        name,
    )
    counts = rows.groupBy(*by, "range_").agg(F.count(F.lit(1)).alias("n_"))
    # a group has one row for each range that it reaches into
    before = W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset_", F.sum("n_").over(before)).where(F.col("offset_").isNotNull()).drop("n_")
    inside = F.row_number().over(W.partitionBy(*by, "range_").orderBy("row_"))
    numbered = rows.withColumn("inside_", inside).join(offsets, [*by, "range_"], "left")
    return numbered.select(*df.columns, (F.col("inside_") + F.coalesce("offset_", F.lit(0))).alias("ordinal"))


def sums_before(df: DataFrame, by: Sequence[str], place: str, sums: Sequence[str], bits: int = 12) -> DataFrame:
    """``df`` with ``before_*``: totals of ``sums`` over smaller places of the same ``by``.

    Places are whole numbers without gaps, so blocks of 2^bits places are bounded;
    block totals are cumulated within blocks of blocks, and those in turn.
    Columns ``block_`` and ``far_`` are taken.
    """
    by = list(by)
    rows = df.withColumns({"block_": F.shiftright(place, bits), "far_": F.shiftright(place, 2 * bits)})
    near = rows.groupBy(*by, "far_", "block_").agg(*[F.sum(c).alias(c) for c in sums])
    far = near.groupBy(*by, "far_").agg(*[F.sum(c).alias(c) for c in sums])
    upto = lambda keys, order: W.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, keys, order: F.coalesce(F.sum(c).over(upto(keys, order)), F.lit(0))
    far = far.select(*by, "far_", *[total(c, by, "far_").alias(f"far_{c}") for c in sums])
    near = near.select(*by, "far_", "block_", *[total(c, [*by, "far_"], "block_").alias(f"near_{c}") for c in sums])
    # nothing stands before a first block
    far, near = far.where("far_ > 0"), near.where("block_ > 0")
    offsets = near.join(far, [*by, "far_"], "left").select(
        *by, "block_", *[(F.col(f"near_{c}") + F.coalesce(f"far_{c}", F.lit(0))).alias(f"offset_{c}") for c in sums]
    )
    inside = rows.withColumns({f"inside_{c}": total(c, [*by, "block_"], place) for c in sums})
    return inside.join(offsets, [*by, "block_"], "left").select(
        *df.columns, *[(F.col(f"inside_{c}") + F.coalesce(f"offset_{c}", F.lit(0))).alias(f"before_{c}") for c in sums]
    )


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns in order, numbered from 1 in each conversation.

    ``rows``: conv_id, turn, role, text; other columns are ignored.  Null turns
    come first; turns of the same number stand in the order of role and text.  A
    null role or text becomes empty.  Repeated rows are turns of their own.  Rows
    without a conv_id belong to no conversation and are left out.
    """
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    return ordinals(turns, ["conv_id"], ["turn", "role", "text"], "turns").select(
        "conv_id", F.col("ordinal").cast("long").alias("place"), "role", "text"
    )


def _names(place: Column, sums: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits that name the prefix of ``place`` turns with these hash sums."""
    return F.xxhash64(place, *sums), F.xxhash64(F.lit(7), *sums, place)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, size, k1, k2, p1, p2): name of each prefix and of the one before it."""
    a, b = F.xxhash64("place", "role", "text"), F.xxhash64(F.lit(1), "place", "text", "role")
    low = F.lit(0xFFFFFFFF)
    rows = turns.select(
        "conv_id",
        "place",
        F.octet_length("text").cast("long").alias("size"),
        a.bitwiseAND(low).alias("s1"),
        F.shiftrightunsigned(a, 32).alias("s2"),
        b.bitwiseAND(low).alias("s3"),
        F.shiftrightunsigned(b, 32).alias("s4"),
    )
    before = [F.col(f"before_{c}") for c in _SUMS]
    k1, k2 = _names(F.col("place"), [b + F.col(c) for b, c in zip(before, _SUMS)])
    p1, p2 = _names(F.col("place") - 1, before)
    return sums_before(rows, ["conv_id"], "place", _SUMS).select(
        "conv_id", "place", "size", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2")
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each node in a sorted batch."""
    for batch in batches:
        k1, k2 = (batch.column(k).to_numpy() for k in range(2))
        ids = batch.column(2).to_pylist()
        if not ids:
            continue
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        begins = np.append(0, cuts)
        ends = np.append(cuts, len(ids)).tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins.tolist(), ends)]
        yield pa.record_batch(
            [pa.array(k1[begins]), pa.array(k2[begins]), pa.array([ids[a] for a in begins.tolist()], pa.int64()), pa.array(texts, pa.string())],
            ["k1", "k2", "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each node, whose rows are neighbours."""
    names = ["k1", "k2", "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    key = state = None
    for batch in batches:
        done: list[tuple] = []
        for k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done) if done else ([], [], []), kinds)], names)
    if key is not None:
        yield pa.record_batch([pa.array([c], t) for c, t in zip((*key, state.hexdigest()), kinds)], names)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from rows (k1, k2, conv_id); ids of a large node are joined by many tasks first."""
    keys = ["k1", "k2"]
    parts = (
        ends.select(*keys, F.col("conv_id").cast("long").alias("conv_id"))
        .repartitionByRange(*keys, "conv_id")
        .sortWithinPartitions(*keys, "conv_id")
        .mapInArrow(_joined_ids, "k1 long, k2 long, first long, ids string")
    )
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def _along(after: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last element reached by ``after`` (-1: none), and the weights passed, by pointer doubling."""
    jump = np.where(after < 0, np.arange(len(after)), after)
    far = np.where(after < 0, 0, weight)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, far
        far, jump = far + far[jump], further


def _places(arcs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted arc among ``arcs``, -1 where it is not there."""
    order = np.argsort(arcs)
    at = np.minimum(np.searchsorted(arcs[order], wanted), len(arcs) - 1)
    return np.where(arcs[order][at] == wanted, order[at], -1)


_LIST = "arc long, next long, w long, gone long, head long, off long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join arcs whose next arc is in the same batch; the others stay as heads of such chains."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        arc = batch.column(0).to_numpy()
        after = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        w = batch.column(2).to_numpy()
        at = _places(arc, after)
        before = np.full(len(arc), -1, np.int64)
        before[at[at >= 0]] = np.flatnonzero(at >= 0)
        # way back to the head: the weight of the arc before leads here
        head, off = _along(before, w[before])
        last, far = _along(at, w)
        heads = np.flatnonzero(before < 0)
        joined = np.flatnonzero(before >= 0)
        none = np.zeros(len(arc), bool)
        none[len(heads) :] = True
        order = np.append(heads, joined)
        end = after[last[order]]
        mask = lambda values, hide: pa.array(values, pa.int64(), mask=hide)
        yield pa.record_batch(
            [
                mask(arc[order], none),
                mask(end, none | (end < 0)),
                mask(far[order] + w[last[order]], none),
                mask(arc[order], ~none),
                mask(arc[head[order]], ~none),
                mask(off[order], ~none),
            ],
            ["arc", "next", "w", "gone", "head", "off"],
        )


def _rank_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distance of every arc of a whole (bounded) list to its end."""
    held = list(batches)
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        arc = table.column(0).to_numpy()
        w = table.column(2).to_numpy()
        last, far = _along(_places(arc, table.column(1).fill_null(-1).to_numpy()), w)
        # the last arc may stand for a chain
        yield pa.record_batch([pa.array(arc), pa.array(far + w[last])], ["arc", "dist"])


def list_ranks(arcs: DataFrame, near: Sequence[str], rest: int = 8192) -> DataFrame:
    """(arc, dist): arcs that stand behind each one on the list.

    ``arcs``: arc (distinct, 0 or more), next (null for the last), and columns
    ``near`` by which neighbours on the list tend to lie close.  At most ``rest``
    arcs are ranked in one task.
    """
    w = F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("w")
    state = written(
        arcs.repartitionByRange(*near).sortWithinPartitions(*near).select("arc", "next", w).mapInArrow(_contract, _LIST),
        "tour-0",
    )
    rounds = [state]
    none = [F.lit(None).cast("long").alias(c) for c in ("gone", "head", "off")]
    while (left := state.where("arc IS NOT NULL")).count() > rest:
        left = left.select("arc", "next", "w")
        coin = lambda c: (F.xxhash64(F.lit(len(rounds)), c).bitwiseAND(1) == 1)
        takes = ~coin(F.col("arc")) & F.col("next").isNotNull() & coin(F.col("next"))
        takers = left.where(takes).select(F.col("arc").alias("t"), F.col("next").alias("arc"), F.col("w").alias("tw"))
        met = left.where(coin(F.col("arc"))).join(takers, "arc", "left")
        taken = F.col("t").isNotNull()
        met = met.select(
            F.coalesce("t", "arc").alias("arc"),
            "next",
            (F.col("w") + F.coalesce("tw", F.lit(0))).alias("w"),
            F.when(taken, F.col("arc")).alias("gone"),
            F.col("t").alias("head"),
            F.col("tw").alias("off"),
        )
        state = written(met.unionByName(left.where(~coin(F.col("arc")) & ~takes).select("arc", "next", "w", *none)), f"tour-{len(rounds)}")
        rounds.append(state)
    ranks = written(left.select("arc", "next", "w").repartition(1).mapInArrow(_rank_rest, "arc long, dist long"), "ranks")
    for state in reversed(rounds):
        gone = state.where("gone IS NOT NULL").select("gone", F.col("head").alias("arc"), "off")
        back = gone.join(ranks, "arc").select(F.col("gone").alias("arc"), (F.col("dist") - F.col("off")).alias("dist"))
        more = written(ranks.unionByName(back), "ranks")
        drop_written(ranks)
        drop_written(state)
        ranks = more
    return ranks


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one (root) included.

    ``turns``: conv_id (a whole number), place (1, 2, ... in each conversation
    without gaps), role and text, none of them null.  ``conversations``: distinct
    conv_id of all conversations, also of those without turns.  Other columns are
    ignored.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs (members: conversations that begin so), n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (bytes of last texts, once for
    each member but one, summed over the subtree) and ends_sha256 (digest of the
    comma-joined ids of members that end here, ascending).  No conversations give
    no rows.  Prefixes are told apart by 128-bit names.
    """
    keyed = written(_prefixes(turns), "prefixes")
    root1, root2 = _names(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    last = keyed.groupBy("conv_id").agg(F.max(F.struct("place", "k1", "k2")).alias("last"))
    ends = conversations.select("conv_id").join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.k1", root1).alias("k1"), F.coalesce("last.k2", root2).alias("k2")
    )
    digests = written(_end_digests(ends), "end-digests")
    inner = keyed.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("place").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("size").alias("size"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    null = F.lit(None).cast("long")
    root = (
        conversations.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"))
        .where("n_convs > 0")
        .select(
            root1.alias("k1"), root2.alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs",
            F.lit(0).cast("long").alias("size"), null.alias("p1"), null.alias("p2"),
        )
    )
    nodes = written(inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = written(nodes.join(above, ["p1", "p2"], "left").drop("p1", "p2"), "linked-nodes")
    children = written(
        ordinals(linked.where("parent IS NOT NULL").select("parent", "conv_id", "depth", "node"), ["parent"], ["conv_id"], "children"),
        "siblings",
    )
    # arcs: 2 * node enters it, 2 * node + 1 leaves it
    first = children.where("ordinal = 1").select(F.col("parent").alias("node"), F.col("node").alias("first"))
    enter = linked.join(first, "node", "left").select(
        (2 * F.col("node")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("node") + 1).alias("next"), "conv_id", "depth"
    )
    follows = children.select("parent", (F.col("ordinal") - 1).alias("ordinal"), F.col("node").alias("sibling"))
    leave = children.join(follows, ["parent", "ordinal"], "left").select(
        (2 * F.col("node") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"), "conv_id", "depth"
    )
    end = linked.where("parent IS NULL").select((2 * F.col("node") + 1).alias("arc"), null.alias("next"), "conv_id", "depth")
    ranks = list_ranks(enter.unionByName(leave).unionByName(end), ["conv_id", "depth"])
    counts = children.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = written(linked.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted-nodes")
    arcs = (
        ranks.withColumns({"node": F.shiftright("arc", 1), "enters": F.col("arc") % 2 == 0})
        .join(linked.select("node", "n_children", "n_convs", "size"), "node")
        .select(
            "node",
            "enters",
            # the tour's last arc has place 0: sums then run from the end backwards
            F.col("dist").alias("place"),
            F.when(F.col("enters") & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
            F.when(F.col("enters"), (F.col("n_convs") - 1) * F.col("size")).otherwise(0).cast("long").alias("saved"),
        )
    )
    sign = F.when(F.col("enters"), 1).otherwise(-1)
    upto = lambda c: F.sum(sign * (F.col(f"before_{c}") + F.col(c))).cast("long")
    sums = (
        sums_before(arcs, [], "place", ["leaf", "saved"])
        .groupBy("node")
        .agg(upto("leaf").alias("n_leaves"), upto("saved").alias("saved_tokens"))
    )
    out = written(linked.join(sums, "node").join(digests, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    ), "trie")
    for table in (keyed, digests, nodes, children, ranks, linked):
        drop_written(table)
    return out
