"""Token ids in bit-plane or byte-plane files.

A chunk holds whole documents.  Its ids are cut into blocks of a fixed number of
ids; a block is transposed into planes (plane k holds byte k, or bit k, of every
id), and each plane is a zstandard frame of its own.  Planes that are zero
throughout are not stored.  A chunk begins with an index of its frames:

    "TKP1", kind (0 byte, 1 bit), three zero bytes,
    block_ids u32, n_ids u64, n_blocks u32,
    planes of each block u8 * n_blocks, frame sizes u32 * all planes, frames

all little-endian.  Chunks are rows of a Parquet table written by Spark's own
committer, so that a lost executor leaves no half file and any store works that
Spark can write; beside the chunk stand the ids and lengths of its documents.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.vocabulary import lean, worker_cache

_HEAD = struct.Struct("<4sB3xIQI")
_MAGIC = b"TKP1"
# white space of the tokenizer's word pattern
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[[ord(c) for c in _SPACE]] = True
# ASCII letters, digits and other signs; 0 for white space, controls and all beyond ASCII
_KIND = np.zeros(129, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


def pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All texts cut at places that are word boundaries whatever stands around them, and how many pieces each has.

    One kind of place is before white space that follows anything else: a word of
    the tokenizer's pattern holds white space at its start only, or is white space
    throughout.  The other is between ASCII letters, digits and other signs, but
    for a letter behind an apostrophe, which may be a contraction.  What stands
    behind such a place is split alike with or without what stands before.
    """
    raw = "".join(texts)
    points = np.frombuffer(raw.encode("utf-32-le"), "<u4")
    n, ends = len(points), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if n == 0:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    space = _IS_SPACE[np.minimum(points, len(_IS_SPACE) - 1)]
    starts = np.zeros(n, bool)
    kind = _KIND[np.minimum(points, 128)]
    starts[1:] = space[1:] & ~space[:-1]
    starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((points[:-1] == 0x27) & (kind[1:] == 1))
    starts[0] = True
    starts[ends[ends < n]] = True
    places = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(places, np.append(0, ends)))
    utf8 = raw.encode()
    if len(utf8) > n:
        width = np.ones(n, np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        places = (np.cumsum(width, dtype=np.int64) - width)[places]
    # a batch of texts is far below 2 GB
    offsets = np.append(places, len(utf8)).astype(np.int32)
    return pa.Array.from_buffers(pa.utf8(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)]), counts


class Encoder:
    """Byte-level BPE of whole texts by the tokenizers library, with a cache of words.

    The ids of a text are the ids of its pieces in turn (see ``pieces``); each
    distinct piece goes to the library once while it is cached.
    """

    def __init__(self, path: str, max_cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cache: dict[str, bytes] = {}
        self._max = max_cached

    def _learn(self, words: Iterable[str]) -> None:
        words = list(words)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            code = self._tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(code.ids, "<u4"), np.array(code.word_ids, np.int64)
            ends = np.searchsorted(of, np.arange(len(some)), side="right")
            begin = 0
            for word, end in zip(some, ends.tolist()):
                self._cache[word] = ids[begin:end].tobytes()
                begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian u32 ids of each text; null counts as empty."""
        words, per_text = pieces([text or "" for text in texts])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self._cache]
        if len(self._cache) + len(missing) > self._max:
            self._cache.clear()
            missing = distinct
        self._learn(missing)
        codes = list(map(self._cache.__getitem__, distinct))
        counts = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat, first = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(counts) - counts
        at = coded.indices.to_numpy()
        many = counts[at]
        stops = np.cumsum(many)
        # the j-th id of a text is the flat id of its piece, moved on within the piece
        ids = flat[np.arange(int(many.sum())) + np.repeat(first[at] - (stops - many), many)]
        edges = np.append(0, stops)[np.append(0, np.cumsum(per_text))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]


_ENCODERS: dict[str, Encoder] = worker_cache("tokens")


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, block_ids: int = 65_536, planes: str = "byte", level: int = 3) -> bytes:
    """A chunk of u32 ``ids``."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    counts, frames = [], []
    blocks = [ids[k : k + block_ids] for k in range(0, len(ids), block_ids)]
    for block in blocks:
        top = int(block.max()).bit_length()
        raw = np.ascontiguousarray(block.astype("<u4")).view(np.uint8).reshape(-1, 4)
        if planes == "byte":
            rows = [raw[:, k] for k in range(-(-top // 8))]
        else:
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            rows = [np.packbits(bits[:, k], bitorder="little") for k in range(top)]
        counts.append(len(rows))
        frames += [squeeze(np.ascontiguousarray(r).tobytes()) for r in rows]
    head = _HEAD.pack(_MAGIC, int(planes == "bit"), block_ids, len(ids), len(blocks))
    return b"".join([head, bytes(counts), np.array([len(f) for f in frames], "<u4").tobytes(), *frames])


def unpack(chunk: bytes) -> np.ndarray:
    """The u32 ids of a chunk made by ``pack``."""
    magic, kind, block_ids, n_ids, n_blocks = _HEAD.unpack_from(chunk)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token planes")
    counts = chunk[_HEAD.size : _HEAD.size + n_blocks]
    at = _HEAD.size + n_blocks
    sizes = np.frombuffer(chunk, "<u4", sum(counts), at)
    ends = at + 4 * len(sizes) + np.cumsum(sizes, dtype=np.int64)
    expand = zstandard.ZstdDecompressor().decompress
    out, plane = np.zeros((n_ids, 4), np.uint8), 0
    for block in range(n_blocks):
        rows = out[block * block_ids : (block + 1) * block_ids]
        planes = []
        for _ in range(counts[block]):
            planes.append(np.frombuffer(expand(chunk[ends[plane] - sizes[plane] : ends[plane]]), np.uint8))
            plane += 1
        if kind == 0:
            for k, values in enumerate(planes):
                rows[:, k] = values
        elif planes:
            bits = np.zeros((len(rows), 32), np.uint8)
            for k, values in enumerate(planes):
                bits[:, k] = np.unpackbits(values, count=len(rows), bitorder="little")
            rows[:] = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


CHUNK_SCHEMA = (
    "shard int, chunk int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_ids: int = 1 << 20,
    block_ids: int = 65_536,
    planes: str = "byte",
    batch_rows: int = 256,
) -> None:
    """Encode whole texts and write chunks in ascending id order below ``path``.

    A null or empty text gives the end id alone.  Null ids come first; rows with
    the same id stand in the order of their text's hash.  An empty table gives an
    empty file set.  A chunk closes once it has ``chunk_ids`` ids, so its size is
    bounded by that and one document.  ``vocabulary`` must exist on every worker.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes must be byte or bit")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocabulary).encode, TaskContext.get().partitionId()
        ids: list = []
        parts: list[bytes] = []
        lengths: list[int] = []
        chunk = first = 0

        def close() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(parts), "<u4")
            row = [[shard], [chunk], [first], [len(tokens)], [ids], [lengths], [pack(tokens, block_ids, planes)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "chunk", "first_id", "n_ids", "doc_ids", "doc_lengths", "payload"]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                some = batch.slice(at, batch_rows)
                for doc, code in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids.append(doc)
                    parts.append(code + end)
                    lengths.append(len(code) // 4 + 1)
                    held += lengths[-1]
                    if held >= chunk_ids:
                        yield close()
                        chunk, first, held = chunk + 1, first + held, 0
                        ids, parts, lengths = [], [], []
        if ids:
            yield close()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
        .repartitionByRange("doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash")
        .select("doc_id", "text")
        .mapInArrow(lean(run, "tokens"), CHUNK_SCHEMA)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian u32 bytes.

    ``start`` counts the ids of all documents before it.  It comes from the
    chunk index alone: one total for each shard, cumulated over shards.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # one row for each written shard
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, docs, lengths, payload = (c[row].as_py() for c in batch.columns)
                raw = unpack(payload).tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                for at in range(0, len(docs), 512):
                    some = slice(at, at + 512)
                    yield pa.record_batch(
                        [
                            pa.array([shard] * len(docs[some]), pa.int32()),
                            pa.array(docs[some], pa.int64()),
                            pa.array(first + begins[some]),
                            pa.array(lengths[some], pa.int64()),
                            pa.array([raw[4 * i : 4 * j] for i, j in zip(begins[some], ends[some])], pa.binary()),
                        ],
                        ["shard", "doc_id", "within", "n_tokens", "ids"],
                    )

    docs = chunks.select("shard", "first_id", "doc_ids", "doc_lengths", "payload").mapInArrow(
        lean(run, "tokens"), "shard int, doc_id long, within long, n_tokens long, ids binary"
    )
    # one row of 16 bytes for each shard: beyond 32 MB the ids are shuffled instead
    if totals.count() <= 2_000_000:
        offsets = F.broadcast(offsets)
    return docs.join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids"
    )
