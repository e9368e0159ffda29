"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a run of slots of equal size.  Slot k falls to the source whose share
of the cumulated targets holds the golden-ratio point frac((k + 1) * phi), so
every stretch of the schedule is close to the targets.  A source's documents are
shuffled, laid end to end and cut into blocks of ``block_words`` words; its r-th
slot takes block r modulo the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.storage import written

GOLDEN = 0.6180339887498949
GOLDEN_STRIDE = 0.607787409740351  # frac(2**20 * golden ratio), taken from its exact value
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    blank = " \t\n\x0b\f\r"
    flat = F.btrim(F.translate(F.coalesce(text, F.lit("")), blank, " " * 6), F.lit(" "))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +", -1))).cast("long")


def source_targets(
    sizes: list[tuple[str | None, int]], weights: tuple[float, ...], total: float, max_repeats: float
) -> dict[str | None, float]:
    """Targets by weight, none above ``max_repeats`` times its source's size.

    Sources in code point order, null last, take ``weights`` in turn.  The excess
    of full sources is shared among the others until none is above its bound.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, full = dict(order), {}
    free = [s for s, _ in order]
    left = float(total)
    while free:
        share = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > max_repeats * size[s]]
        if not over:
            return full | {s: left * weight[s] / share for s in free}
        for s in over:
            full[s] = float(max_repeats * size[s])
        left = float(total) - sum(full.values())
        free = [s for s in free if s not in full]
    return full


def _running(df: DataFrame, keys: list[str], lane: str, order: list, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all earlier rows of its keys.

    ``lane`` cuts each key into ordered pieces: lane totals are cumulated over
    lanes, and rows are ordered within one lane only.
    """
    lanes = df.groupBy(*keys, lane).agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(lane).rowsBetween(W.unboundedPreceding, -1)
    lanes = lanes.select(*keys, lane, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, lane).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = [summed[k].eqNullSafe(lanes[k]) for k in (*keys, lane)]
    joined = summed.join(lanes, same[0] if len(same) == 1 else same[0] & same[1])
    return joined.select(*[summed[c] for c in df.columns], (F.col("_before") + F.col("_inside")).alias(name))


class Mix:
    """The parts of a mix: ``sources``, ``documents``, ``pieces``, ``schedule`` and ``taken``."""

    def __init__(self, sources, documents, pieces, schedule, taken):
        self.sources, self.documents, self.pieces = sources, documents, pieces
        self.schedule, self.taken = schedule, taken


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    total_share: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 64,
    lane_rows: int = 4096,
    max_sources: int = 100_000,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Mix ``docs`` so that sources come near their targets.

    - ``sources``: source, source_size, target, blocks
    - ``documents``: doc_id, source, size, source_size, target, place (the words
      of its source before it in the shuffled order)
    - ``pieces``: source, place, block, words: which words of which block a document has
    - ``schedule``: slot, source, rank, block, part: the mix in order
    - ``taken``: documents with taken, the words the mix takes, repeats counted

    The targets add up to ``total_share`` times all words.  No block is used more
    than ``max_repeats`` times: a slot beyond that is left empty.  Sources are
    collected for the targets, one row each, and refused above ``max_sources``.
    A null source is a source.  Documents without words are taken with 0 words.
    Repeated rows are separate documents.  The order depends on the id, the
    text's size and ``seed`` only, so reruns agree.
    """
    # texts are read once; everything below works on ids and sizes
    plain = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
        ),
        "document-sizes",
    )
    totals = plain.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    found = totals.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources")
    spark = docs.sparkSession
    goal = source_targets(
        [(r["source"], r["source_size"]) for r in found],
        weights,
        total_share * sum(r["source_size"] for r in found),
        max_repeats,
    )
    order = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    slots = [goal[r["source"]] / block_words for r in order]
    edges, reach = [], 0.0
    for s in slots:
        edges.append(reach)
        reach += s
    rows = [
        (
            i,
            r["source"],
            r["source_size"],
            goal[r["source"]],
            -(-r["source_size"] // block_words),
            max(1, -(-r["rows"] // lane_rows)),
            edges[i] / reach if reach else 0.0,
        )
        for i, r in enumerate(order)
    ]
    sources = spark.createDataFrame(
        rows,
        "part int, source string, source_size long, target double, blocks long, lanes long, edge double",
    )
    small = F.broadcast(sources)  # at most max_sources rows

    shuffle = F.xxhash64(F.lit(seed), "doc_id", "size")
    places = plain.join(small, plain["source"].eqNullSafe(sources["source"])).select(
        "doc_id",
        plain["source"],
        "part",
        "size",
        "source_size",
        "target",
        F.pmod(shuffle, F.col("lanes")).alias("lane"),
        shuffle.alias("shuffle"),
    )
    places = _running(places, ["part"], "lane", ["shuffle", "doc_id", "size"], "size", "place")
    documents = written(
        places.select("doc_id", "source", "part", "size", "source_size", "target", "place"), "document-places"
    )

    pieces = (
        documents.where(F.col("size") > 0)
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("place") / block_words),
                    F.floor((F.col("place") + F.col("size") - 1) / block_words),
                )
            ),
        )
        .select(
            "source",
            "part",
            "place",
            "block",
            (
                F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block_words)
                - F.greatest(F.col("place"), F.col("block") * block_words)
            ).alias("words"),
        )
    )

    # slot -> source: the last source whose edge is not above the slot's point
    bounds = [(r[0], r[6]) for r in rows if slots[r[0]] > 0]
    # k is cut at 20 bits, so that the points of very long schedules keep their precision
    far, near = F.shiftright("k", 20) * F.lit(GOLDEN_STRIDE), F.col("k").bitwiseAND(0xFFFFF) * F.lit(GOLDEN)
    point = (far % F.lit(1.0) + near % F.lit(1.0)) % F.lit(1.0)
    part = F.lit(bounds[0][0] if bounds else 0)
    if len(bounds) > 1:
        # the place of the point among the sorted edges, as a literal array searched natively
        above = F.filter(F.array(*[F.lit(e) for _, e in bounds]), lambda e: e <= F.col("point"))
        part = F.get(F.array(*[F.lit(p) for p, _ in bounds]), F.size(above) - 1)
    n_slots = int(round(reach)) if bounds else 0
    drawn = (
        spark.range(n_slots)
        .select((F.col("id") + 1).alias("k"))
        .withColumn("point", point)
        .select(F.col("k"), part.alias("part"), F.floor(F.col("k") / 65536).alias("lane"), F.lit(1).alias("one"))
    )
    ranked = _running(drawn, ["part"], "lane", ["k"], "one", "rank")
    schedule = (
        ranked.join(small.select("part", "source", "blocks"), "part")
        .where(F.col("rank") < max_repeats * F.col("blocks"))
        .select(F.col("k").alias("slot"), "source", "part", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    )
    used = schedule.groupBy("part", "block").agg(F.count(F.lit(1)).alias("uses"))
    got = (
        pieces.join(used, ["part", "block"])
        .groupBy("part", "place")
        .agg(F.sum(F.col("words") * F.col("uses")).alias("_taken"))
        .select(F.col("part").alias("_part"), F.col("place").alias("_place"), "_taken")
    )
    taken = (
        documents.join(
            got, (F.col("part") == F.col("_part")) & (F.col("place") == F.col("_place")) & (F.col("size") > 0), "left"
        )
        .withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))
        .drop("part", "_part", "_place", "_taken")
    )
    return Mix(sources.drop("lanes", "edge"), documents, pieces, schedule, taken)
