"""File manifests and partition fingerprints for incremental rebuilds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import UNIT_KEYS
from tidemark.session import scratch_folder


# what Hadoop's readers unpack by a file's name, so that its bytes are not seen
_PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
_BOM = b"\xef\xbb\xbf"
# Parquet's writer holds at least a hundred values before it looks at their size
_PIECE_BYTES = 1 << 16
_STATE_BYTES = 112  # OpenSSL's SHA256_CTX


def _openssl() -> ctypes.CDLL | None:
    """OpenSSL as linked by ``hashlib``, whose SHA-256 state is plain bytes that a later task can go on with."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
    except (ImportError, OSError, AttributeError):
        return None
    return library


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a file range joined again; the break before a line belongs to it."""
    at, seq = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, starts, lines = batch.column("key").dictionary_encode(), batch.column("start").to_numpy(), batch.column("line")
        codes = keys.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            here = (keys.dictionary[int(codes[a])].as_py(), int(starts[a]))
            head = b"" if here != at and here[1] == 0 else b"\n"
            at, seq = here, seq + 1 if here == at else 0
            text = head + b"\n".join(lines.slice(a, b - a).to_pylist())
            parts = [text[i : i + _PIECE_BYTES] for i in range(0, len(text), _PIECE_BYTES)]
            count = len(parts)
            columns = [
                pa.array([here[0]] * count, pa.string()),
                pa.array([here[1]] * count, pa.int64()),
                pa.array(range(seq, seq + count), pa.int64()),
                pa.array([len(p) for p in parts], pa.int64()),
                pa.array(parts, pa.binary()),
            ]
            seq += count - 1
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "seq", "bytes", "piece"])


def _relay(states: dict[str, bytes]):
    """Goes on with each file's SHA-256 state over its sorted pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, now = _openssl(), {}
        for batch in batches:
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece")):
                if key not in now:
                    now[key] = ctypes.create_string_buffer(states[key], _STATE_BYTES)
                data = piece.as_py()
                library.SHA256_Update(now[key], data, ctypes.c_size_t(len(data)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(now), pa.string()), pa.array([c.raw for c in now.values()], pa.binary())], ["key", "state"]
        )

    return run


def _relayed_digests(lines: DataFrame, lengths: dict[str, int], round_bytes: int) -> list[tuple[str, str]]:
    """SHA-256 of large files: ranges are read once, and hashed one range of each file a round."""
    spark, library = lines.sparkSession, _openssl()
    pieces = lines.mapInArrow(_pieces, "key string, start long, seq long, bytes long, piece binary")
    path = scratch_folder(spark, "manifest")
    dealt = pieces.withColumn("round", F.floor(F.col("start") / round_bytes))
    plain = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
    dealt.write.options(**plain).partitionBy("round").parquet(path)
    saved = spark.read.parquet(path)
    read = {r.key: r.n for r in saved.groupBy("key").agg(F.sum("bytes").alias("n")).collect()}
    states, missing = {}, {}
    for key, length in lengths.items():
        # the reader hides a byte order mark at the start and a break at the end
        missing[key] = length - read.get(key, 0)
        if missing[key] not in (0, 1, 3, 4):
            raise RuntimeError(f"{key} changed while it was read")
        state = ctypes.create_string_buffer(_STATE_BYTES)
        library.SHA256_Init(state)
        if missing[key] >= 3:
            library.SHA256_Update(state, _BOM, ctypes.c_size_t(3))
        states[key] = state.raw
    for number in range(max(lengths.values()) // round_bytes + 1):
        part = saved.where(F.col("round") == number).select("key", "start", "seq", "piece")
        dealt = part.repartition("key").sortWithinPartitions("key", "start", "seq")
        # one state of 112 bytes for each large file
        states |= {r.key: bytes(r.state) for r in dealt.mapInArrow(_relay(states), "key string, state binary").collect()}
    digests = []
    for key, raw in states.items():
        state, out = ctypes.create_string_buffer(raw, _STATE_BYTES), ctypes.create_string_buffer(32)
        if missing[key] in (1, 4):
            library.SHA256_Update(state, b"\n", ctypes.c_size_t(1))
        library.SHA256_Final(out, state)
        digests.append((key, out.raw.hex()))
    return digests


def file_manifest(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", whole_bytes: int = 64 << 20, round_bytes: int = 128 << 20
) -> DataFrame:
    """Path, size, modification time and SHA-256 of each file.

    Files up to ``whole_bytes`` are read in one piece.  Larger ones are read by
    Spark in ranges, which are hashed in the order of the file, ``round_bytes`` of
    each file a round: a task takes over the state that the round before left.
    Files that Spark would unpack by their name are always read in one piece, and so
    are all files where Python's ``hashlib`` has no OpenSSL.  Empty files are not listed by Spark.
    """

    def scan(kind: str):
        return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)

    listed = scan("binaryFile").load(folder)
    columns = ["path", F.col("length").alias("size"), "modificationTime"]
    # Spark leaves files out by these columns while it lists, before it opens any
    large = (F.col("_metadata.file_size") > whole_bytes) & ~F.col("_metadata.file_path").rlike(_PACKED)
    if _openssl() is None:
        large = F.lit(False)
    whole = listed.where(~large).select(*columns, F.sha2("content", 256).alias("sha256"))
    ranged = listed.where(large).select(*columns, F.col("_metadata.file_path").alias("key"))
    lengths = {r.key: r.size for r in ranged.select("key", "size").collect()}
    if not lengths:
        return whole
    lines = (
        scan("text")
        .option("lineSep", "\n")
        .load(folder)
        .where(large)
        .select(
            F.col("_metadata.file_path").alias("key"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("line"),
        )
    )
    digests = spark.createDataFrame(_relayed_digests(lines, lengths, round_bytes), "key string, sha256 string")
    return whole.unionByName(ranged.join(digests, "key").drop("key"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    b = before.select("path", F.col("sha256").alias("old"))
    a = after.select("path", F.col("sha256").alias("new"))
    joined = a.join(b, "path", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(
            F.col("old") != F.col("new"), "changed"
        )
    )
    return joined.select("path", change.alias("change")).where(F.col("change").isNotNull())


def partition_fingerprints(spark: SparkSession, root: str, settings: str) -> DataFrame:
    """One hash per unit and period over its files' names, sizes and times.

    The folder is listed and no file is opened; unit and period come from the
    partition folders' names.  ``settings`` is any text describing the build;
    changing it changes every fingerprint.  Files outside such folders, and hidden
    ones, are left out.
    """
    # without its content column this source only lists
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(root)
    of = lambda key: F.url_decode(
        # a plus stands for itself in folder names
        F.replace(F.regexp_extract("path", f"/{key}=([^/]+)/", 1), F.lit("+"), F.lit("%2B"))
    ).alias(key)
    files = listed.select(
        *[of(key) for key in UNIT_KEYS],
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("string").alias("modified"),
    ).where(" AND ".join(f"{key} <> ''" for key in UNIT_KEYS))
    return files.groupBy(*UNIT_KEYS).agg(
        F.sha2(
            F.concat_ws(
                "|",
                F.lit(settings),
                F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "size", "modified"))), "|"),
            ),
            256,
        ).alias("fingerprint")
    )


def stale_partitions(current: DataFrame, built: DataFrame) -> DataFrame:
    """Unit-periods whose fingerprint is absent from the built manifest."""
    return current.join(built.select(*UNIT_KEYS, "fingerprint"), [*UNIT_KEYS, "fingerprint"], "left_anti")


def rebuild_partitions(rows: DataFrame, root: str) -> None:
    """Replace only the unit-periods present in ``rows``, spread over tasks by entity."""
    writers = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartition(*UNIT_KEYS, F.pmod(F.hash("entity"), F.lit(writers)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*UNIT_KEYS)
        .parquet(root)
    )
