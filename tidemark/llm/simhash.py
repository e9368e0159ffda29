"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Documents whose fingerprints differ in few bits are linked.  Fingerprints are
cut into ``max_distance + exact_blocks`` bit blocks; two that differ in at most
``max_distance`` bits agree in at least ``exact_blocks`` of them.  Every choice
of that many blocks is a masked pattern at the top of the index, and Spark deals
the fingerprints by pattern.  Below it a task sorts its fingerprints by Gray
rank and searches the hierarchy of ``gray_index``.  So no link is lost, and no
task sees more than two chunks of a pattern: a pattern with more members than
``chunk_rows`` is cut into chunks, and each pair of chunks is searched by itself.

A task passes on a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.components import connected_components, merge_labels, spanning_forest
from tidemark.llm.gray_index import GrayIndex
from tidemark.llm.storage import free_names, written
from tidemark.llm.vocabulary import lean

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_BYTE = np.arange(8) * 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, A-Z in lower case, repeats included.

    Words are runs of anything but ASCII white space.  A text with fewer words
    has one shingle, one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size) - 1
    begin = (end + 1 - size)[: len(parts) - words + 1].tolist()
    return np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(begin, end[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set when it is set in more than half of ``hashes``; as a signed long."""
    if len(hashes) == 0:
        return 0
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE
    ones = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fingerprint) of every row; a null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def gray_rank(code: Column) -> Column:
    """The rank of a fingerprint in Gray order: each bit is the parity of those above."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def block_masks(blocks: int, exact_blocks: int) -> list[int]:
    """Masks (signed longs) of every choice of ``exact_blocks`` of the bit blocks."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    masks = [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), exact_blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _by_group(work, names: list[str], flush_rows: int = 100_000):
    """Hands the whole (mask, pattern, pair) groups of a sorted partition of longs to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def emit(table: np.ndarray):
            return pa.record_batch([pa.array(c) for c in work(table)], names)

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows < flush_rows:
                continue
            table = np.concatenate(held, axis=1)
            last = (table[:3] != table[:3, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield emit(table[:, :cut])
            held, rows = [table[:, cut:]], table.shape[1] - cut
        if rows:
            yield emit(np.concatenate(held, axis=1))

    return run


def _group_starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))


def _search(limit: int, exact: bool):
    """Spanning links of each (mask, pattern, pair) group of a sorted partition."""

    def work(table: np.ndarray):
        code, node = table[3], table[4]
        index, n = GrayIndex(code.view(np.uint64), _group_starts(table[:3])), len(code)
        if not exact:
            label = np.arange(n)
            for i, j, _ in index.links(limit):
                label = merge_labels(label, i, j)
            at = np.flatnonzero(label != np.arange(n))
            return node[label[at]], node[at], np.zeros(len(at), np.int64)
        a = b = d = np.empty(0, np.int64)
        for i, j, w in index.links(limit, exact=True):
            a, b, d = np.append(a, i), np.append(b, j), np.append(d, w)
            keep = spanning_forest(n, a, b, d)
            a, b, d = a[keep], b[keep], d[keep]
        return node[a], node[b], d

    return _by_group(work, ["a", "b", "distance"])


def _deal(codes: DataFrame, blocks: int, exact_blocks: int, chunk_rows: int) -> DataFrame:
    """(mask, pattern, pair, fingerprint, node, other columns of ``codes``), each group sorted in one partition."""
    code, more = F.col("fingerprint"), [c for c in codes.columns if c not in ("fingerprint", "node")]
    dealt = codes.select(
        "fingerprint",
        "node",
        *more,
        F.posexplode(F.array(*[code.bitwiseAND(F.lit(m)) for m in block_masks(blocks, exact_blocks)])).alias(
            "mask", "pattern"
        ),
    )
    crowded = written(
        dealt.groupBy("mask", "pattern")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > chunk_rows)
        .select("mask", "pattern", F.ceil(F.col("n") / chunk_rows).cast("long").alias("chunks")),
        "crowded-patterns",
    )
    chunks = F.coalesce("chunks", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("fingerprint", "node"), chunks)
    pairs = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda x: x != own),
            lambda x: F.least(own, x) * chunks + F.greatest(own, x),
        )
    )
    groups = dealt.join(crowded, ["mask", "pattern"], "left").select(
        F.col("mask").cast("long").alias("mask"), "pattern", F.explode(pairs).alias("pair"), "fingerprint", "node", *more
    )
    return _sorted_groups(groups)


def _sorted_groups(groups: DataFrame) -> DataFrame:
    return (
        groups.repartition("mask", "pattern", "pair")
        .withColumn("rank", gray_rank(F.col("fingerprint")))
        .sortWithinPartitions("mask", "pattern", "pair", "rank")
        .select(*groups.columns)
    )


def fingerprint_links(
    codes: DataFrame,
    max_distance: int = 4,
    exact_blocks: int = 2,
    chunk_rows: int = 4096,
    exact: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """(a, b, distance): links that span all groups of ``codes`` (fingerprint, node).

    Without ``exact`` each member is linked to the first of its group, however
    far, and the distance is 0.
    ``codes`` has one row for each distinct fingerprint.  More ``exact_blocks``
    make patterns longer and rarer at the price of more copies of each
    fingerprint; take as many as keep 64 * exact_blocks / (max_distance +
    exact_blocks) bits near the logarithm of the number of fingerprints.
    ``exact`` keeps the lightest links and their true distances.  With fewer
    ``blocks`` than ``max_distance + exact_blocks`` links above ``blocks -
    exact_blocks`` bits are found only where enough blocks agree.
    """
    groups = _deal(codes.select("fingerprint", "node"), blocks or max_distance + exact_blocks, exact_blocks, chunk_rows)
    return groups.mapInArrow(_search(max_distance, exact), "a long, b long, distance long")


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_distance: int = 4,
    exact_blocks: int = 2,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_distance`` bits.  Rows with a null id keep their fingerprint and get a
    null component; they link nothing.  Repeated rows, ties and empty texts need
    no care: equal fingerprints are one node.  Ids must be integers.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(
        prints.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("node")),
        "distinct-fingerprints",
    )
    links = fingerprint_links(nodes, max_distance, exact_blocks)
    roots = connected_components(links.select("a", "b"))
    return _with_groups(prints, nodes, roots)


_GATHER = 1 << 22  # shingles compared at once: bounds a task's memory
_TILE = 1 << 17  # pairs of fingerprints compared at once
_PARITIES = 16  # words of 64 parities each
_MEMBER = ["mask", "pattern", "pair", "fingerprint", "node", "twin", "size"]


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes."""
    return np.unique(shingle_hashes(text, words))


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of 1,024 shares of the hashes holds an odd number of them, as signed longs."""
    counts = np.bincount((hashes % np.uint64(64 * _PARITIES)).astype(np.int64), minlength=64 * _PARITIES)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


TWIN_LIMIT = 24  # 0.8 similar sets differ in about 10 of 64 bits, unlike ones in 32; both with a spread of 3 to 4


def _twin(hashes: np.ndarray) -> int:
    """A second fingerprint, of the hashes mixed anew."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return fingerprint(mixed ^ (mixed >> np.uint64(29)))


class _Candidates:
    """Which pairs of a group are to be compared, and by whom.

    A pair within ``limit`` bits whose set sizes allow ``least`` similarity and
    whose second fingerprints are not far apart is compared under the first
    choice of blocks that both agree in, and nowhere else.
    """

    def __init__(self, limit: int, blocks: int, exact_blocks: int, least: float):
        edge = [64 * k // blocks for k in range(blocks + 1)]
        self.parts = [np.uint64(((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1)) for k in range(blocks)]
        chosen = list(combinations(range(blocks), exact_blocks))
        self.earlier = np.array([[k not in c and k < max(c) for c in chosen] for k in range(blocks)])
        self.limit, self.least = limit, least

    def _near(self, code: np.ndarray, twin: np.ndarray, size: np.ndarray, starts: np.ndarray):
        """Pairs of a group whose sizes, fingerprints and second fingerprints are near, tile by tile.

        Members are ordered by size, so a member meets only those whose size allows
        ``least`` similarity.
        """
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
            if end - begin < 2:
                continue
            order = begin + np.argsort(size[begin:end], kind="stable")
            own, other, length = code[order], twin[order], size[order]
            upto = np.searchsorted(self.least * length, length, side="right")
            i = 0
            while i < len(order) - 1:
                # a tile about as high as wide holds few pairs that sizes rule out
                width = int(upto[i]) - i
                rows = max(1, min(len(order) - i, _TILE // width, max(128, width)))
                width = int(upto[i + rows - 1]) - i
                while rows > 1 and rows * width > 2 * _TILE:
                    rows //= 2
                    width = int(upto[i + rows - 1]) - i
                near = np.bitwise_count(own[i : i + rows, None] ^ own[None, i : i + width]) <= self.limit
                left, right = np.divmod(np.flatnonzero(near), width)
                left, right = left + i, right + i
                fits = (left < right) & (right < upto[left])
                left, right = left[fits], right[fits]
                fits = np.bitwise_count(other[left] ^ other[right]) <= TWIN_LIMIT
                if fits.any():
                    yield order[left[fits]], order[right[fits]]
                i += rows

    def pairs(self, mask: np.ndarray, code: np.ndarray, twin: np.ndarray, size: np.ndarray, starts: np.ndarray):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for found in itertools.chain(self._near(code, twin, size, starts), [None]):
            if found is not None:
                held.append(found)
                rows += len(found[0])
                if rows < _TILE:
                    continue
            if not rows:
                continue
            i, j = (np.concatenate(side) for side in zip(*held))
            held, rows = [], 0
            differ = code[i] ^ code[j]
            taken = np.zeros(len(i), bool)
            for part, earlier in zip(self.parts, self.earlier):
                taken |= earlier[mask[i]] & (differ & part == 0)
            if not taken.all():
                yield i[~taken], j[~taken]

    def members(self):
        """The rows of each group that have a pair to compare."""

        def work(table: np.ndarray):
            some = np.zeros(table.shape[1], bool)
            code, twin = table[3].view(np.uint64), table[5].view(np.uint64)
            for i, j in self.pairs(table[0], code, twin, table[6], _group_starts(table[:3])):
                some[i] = some[j] = True
            return table[:7, some]

        return _by_group(work, _MEMBER)

    def likely_members(self):
        """Of these, the rows of pairs whose sets may be similar, by their parities.

        Each element that only one of two sets has turns one parity, so sets differ
        in at least as many elements as their parities do.  No similar pair is lost.
        """

        def work(table: np.ndarray):
            some = np.zeros(table.shape[1], bool)
            code, twin, size = table[3].view(np.uint64), table[5].view(np.uint64), table[6]
            parity = np.ascontiguousarray(table[7:].T).view(np.uint64)
            for pairs in self.pairs(table[0], code, twin, size, _group_starts(table[:3])):
                for i, j in zip(*(np.array_split(side, 1 + len(side) // _TILE) for side in pairs)):
                    apart = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
                    # similarity s leaves (1 - s) / (1 + s) of both sizes together
                    likely = apart * (1 + self.least) <= (size[i] + size[j]) * (1 - self.least) + 0.001
                    some[i[likely]] = some[j[likely]] = True
            return table[:6, some]

        return _by_group(work, _MEMBER[:6])

    def similar(self):
        """Links (a, b) that span what is similar in each group, set against set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, code, node, twin, sets = None, [], [], [], []
            links: list[np.ndarray] = []

            def settle():
                if len(node) > 1:
                    own = np.array(node, np.int64)
                    codes = np.array([code, twin], np.int64).view(np.uint64)
                    links.append(own[np.stack(self._compared(key[0], *codes, sets))])

            def emit():
                a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
                links.clear()
                return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in range(3)))
                rest = (batch.column(c).to_pylist() for c in (3, 4, 5))
                for now, c, n, t, s in zip(keys, *rest, batch.column(6)):
                    if now != key:
                        settle()
                        key, code, node, twin, sets = now, [], [], [], []
                    code.append(c)
                    node.append(n)
                    twin.append(t)
                    sets.append(np.frombuffer(s.as_buffer(), np.uint64))
                yield emit()
            settle()
            yield emit()

        return run

    def _compared(self, mask: int, code: np.ndarray, twin: np.ndarray, sets: list) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(code), np.array([len(s) for s in sets])
        begin = np.cumsum(size) - size
        known, of = np.unique(np.concatenate(sets), return_inverse=True)
        own, label = np.zeros(len(known), bool), np.arange(n)
        for i, j in self.pairs(np.full(n, mask), code, twin, size, np.zeros(1, np.int64)):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            edges = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for left, others in zip(i[edges], np.split(j, edges[1:])):
                own[of[begin[left] : begin[left] + size[left]]] = True
                # pairs that similar ones join already need no comparison
                others = others[label[others] != label[left]]
                piece = np.cumsum(size[others]) // _GATHER
                for right in np.split(others, np.flatnonzero(np.diff(piece)) + 1) if len(others) else []:
                    hits = own[of[np.concatenate([np.arange(begin[r], begin[r] + size[r]) for r in right])]]
                    both = np.add.reduceat(hits, np.cumsum(size[right]) - size[right], dtype=np.int64)
                    right = right[both / (size[left] + size[right] - both) >= self.least]
                    if len(right):
                        label = merge_labels(label, np.full(len(right), left), right)
                own[of[begin[left] : begin[left] + size[left]]] = False
        at = np.flatnonzero(label != np.arange(n))
        return label[at], at


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    min_similarity: float = 0.8,
    max_distance: int = 18,
    exact_blocks: int = 2,
    blocks: int = 14,
    chunk_rows: int = 4096,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of texts whose shingle sets are similar.

    Fingerprints here count each shingle once, so they need not equal those of
    ``fingerprints``; texts of one shingle set are one node.  They lead to
    candidates: all pairs within ``blocks - exact_blocks``
    bits, and of those up to ``max_distance`` bits the ones that agree in
    ``exact_blocks`` of the ``blocks``.  Sets of Jaccard similarity 0.8 differ in
    about 10 bits, with a spread of 3.  The rows that have a candidate are dealt
    again with 1,024 parities of their sets, which tell most unlike ones for sure,
    and the rest with their sets of shingle hashes; each candidate is compared by the
    Jaccard similarity of the full sets and links from ``min_similarity`` on;
    only then links are reduced to those that span.  Nulls are treated as in
    ``near_duplicate_groups``.
    """

    parities = [f"parity{k}" for k in range(_PARITIES)]
    names = ["doc_id", "fingerprint", "twin", "size", "whole", *parities]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = _shingle_set(text, words)
                whole = np.array([xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0]
                out.append((fingerprint(own), _twin(own), len(own), whole, *_parities(own).tolist()))
            columns = np.array(out, np.int64).reshape(-1, len(names) - 1).T
            yield pa.record_batch([batch.column(0), *map(pa.array, columns)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    prints = written(
        docs.select(id_col, text_col).mapInArrow(lean(sized), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:])),
        "fingerprints",
    )
    nodes = written(
        prints.where(F.col("doc_id").isNotNull())
        .groupBy("fingerprint", "twin", "size", "whole", *parities)
        .agg(F.min("doc_id").cast("long").alias("node")),
        "distinct-sets",
    )
    # a node is a shingle set; sets that share a fingerprint are candidates like others
    candidates = _Candidates(max_distance, blocks, exact_blocks, min_similarity)
    near = written(
        _deal(nodes.drop("whole", *parities), blocks, exact_blocks, chunk_rows).mapInArrow(
            lean(candidates.members()), ", ".join(f"{c} long" for c in _MEMBER)
        ),
        "near-candidates",
    )
    # most rows that chance has brought near leave before they meet their sets
    known = near.join(nodes.select("node", *parities), "node").select(*_MEMBER, *parities)
    dealt = written(
        _sorted_groups(known).mapInArrow(lean(candidates.likely_members()), ", ".join(f"{c} long" for c in _MEMBER[:6])),
        "candidates",
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    sets = (
        docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
        .join(dealt.select("node").distinct(), "node", "left_semi")
        .mapInArrow(lean(shingled), "node long, shingles binary")
        .groupBy("node")
        .agg(F.min("shingles").alias("shingles"))
    )
    similar = _sorted_groups(
        dealt.join(sets, "node").select("mask", "pattern", "pair", "fingerprint", "node", "twin", "shingles")
    ).mapInArrow(lean(candidates.similar()), "a long, b long")
    return _with_groups(prints, nodes, connected_components(similar), names[1:5])


def _with_groups(prints: DataFrame, nodes: DataFrame, roots: DataFrame, key=("fingerprint",)) -> DataFrame:
    groups = nodes.join(roots, "node", "left").select(*key, F.coalesce("root", "node").alias("component_id"))
    return prints.join(groups, list(key), "left").select(
        "doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the smallest id of each group only, once each; rows with a null id stay."""
    (name,) = free_names(docs, "_kept")
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(name), "left_semi")
    return named.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))


def hex_fingerprint(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
