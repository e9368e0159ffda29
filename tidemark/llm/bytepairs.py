"""Byte-level BPE, encoding and decoding, by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: one slot
for each entry, no empty slots) resolves all pre-tokens of a batch that are
entries themselves, in a few NumPy steps.  Tier two: a pre-token that is no entry
is merged from its bytes, which form a linked list; a heap holds the possible
merges by rank and place.  Work is per Arrow batch inside the scan's own tasks:
no shuffle, and a text's place or size never matters.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop as _pop
from heapq import heappush as _push

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NO_SLOT = -1
_LOW = (1 << 32) - 1


def _halves(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of each entry."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, entries), np.uint64, len(entries))
    return h & np.uint64(_LOW), h >> np.uint64(32)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: entry -> its number in the given list.

    An entry's bucket holds a displacement, which is mixed with its hash into a slot.
    Buckets are placed from the fullest down; a bucket of one entry takes the
    next free slot by its number alone.
    """

    def __init__(self, entries: list[bytes], per_bucket: int = 4):
        if len(set(entries)) != len(entries):
            raise ValueError("entries must be distinct")
        n = len(entries)
        self.size, self.buckets = n, max(1, -(-n // per_bucket))
        self.displacement = np.zeros(self.buckets, np.int64)
        self.entry_at = np.full(max(n, 1), _NO_SLOT, np.int64)
        self.entries = np.empty(n, object)
        self.entries[:] = entries
        if n == 0:
            return
        low, high = _halves(entries)
        bucket = (high % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            mine = order[first[b] : first[b] + sizes[b]]
            base = np.uint64(0)
            while True:
                slots = self._slot(low[mine][:, None], high[mine][:, None], (base + tries)[None, :])
                ordered = np.sort(slots, axis=0)
                fits = free[slots].all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
                if fits.any():
                    at = int(np.argmax(fits))
                    self.displacement[b] = int(base) + at + 1
                    self.entry_at[slots[:, at]] = mine
                    free[slots[:, at]] = False
                    break
                base += np.uint64(256)
        # single entries: the displacement names the slot, as a negative number
        alone = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(free)
        self.displacement[alone] = -slots - 1
        self.entry_at[slots] = order[first[alone]]

    def _slot(self, low: np.ndarray, high: np.ndarray, d: np.ndarray) -> np.ndarray:
        # products wrap around; every displacement gives another, unrelated slot
        mixed = (low + d * np.uint64(0x9E3779B97F4A7C15)) * (high | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for words that are no entries."""
        if self.size == 0 or not words:
            return np.full(len(words), -1, np.int64)
        low, high = _halves(words)
        d = self.displacement[(high % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(low, high, np.maximum(d, 0).astype(np.uint64)))
        entry = self.entry_at[slot]
        same = np.fromiter(map(bytes.__eq__, self.entries[entry].tolist(), words), bool, len(words))
        return np.where(same, entry, -1)


#: The split pattern that ``pre_tokens`` computes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point, as the ``regex`` library has it."""
    if not _CLASSES:
        points = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000))
        text, out = points.tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            found = "".join(regex.findall(pattern, text))
            out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Matches of ``PATTERN`` in all texts one after the other, and how many each text has.

    Runs of one class of letters are found for all texts at once.  A blank goes to
    the run behind it; of other white space before a run the last is a match of its
    own; a contraction counts where its apostrophe starts a match.
    """
    raw = "".join(texts)
    points = np.frombuffer(raw.encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = len(points)
    if n == 0:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    kind = _classes()[points]
    text_starts = np.zeros(n + 1, bool)
    text_starts[ends - sizes] = True
    text_starts[n] = True
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= text_starts[:n]
    behind = np.flatnonzero(starts[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~text_starts[1:n]) + 1
    starts[behind - 1] = True
    starts[behind[points[behind - 1] == 0x20]] = False
    marks = np.flatnonzero(starts & (points == 0x27))
    if len(marks):
        # how many letters before the next text each mark has
        room = ends[np.searchsorted(ends, marks, side="right")] - marks
        one, two = points[np.minimum(marks + 1, n - 1)], points[np.minimum(marks + 2, n - 1)]
        is_ = lambda letters: np.isin(one, [ord(c) for c in letters])
        pair = ((one == ord("l")) & (two == ord("l"))) | (is_("rv") & (two == ord("e")))
        length = np.where((room > 1) & is_("stmd"), 2, np.where((room > 2) & pair, 3, 0))
        marks, length = marks[length > 0], length[length > 0]
        starts[marks + 1] = False
        behind = marks + length
        starts[behind[behind < n]] = True
    places = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(places, np.append(0, ends)))
    utf8 = raw.encode()
    if len(utf8) > n:
        width = np.ones(n, np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[places], len(utf8))
    else:
        offsets = np.append(places, n)
    # texts of one call are far below 2 GB
    return pa.Array.from_buffers(pa.utf8(), len(places), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(utf8)]), counts


def _cut(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about ``most`` letters, cut before blanks that always start a match."""
    at = 0
    while len(text) - at > most:
        edge = at + most
        while edge > at and not (text[edge] == " " and not text[edge - 1].isspace() and text[edge - 1] > "\x7f" or
                                 text[edge] == " " and "!" <= text[edge - 1] <= "~"):
            edge -= 1
        if edge == at:  # no such blank: go on to the right
            edge = at + most
            while edge < len(text) and not (text[edge] == " " and "!" <= text[edge - 1] <= "~"):
                edge += 1
        yield text[at:edge]
        at = edge
    yield text[at:]


class BytePairs:
    """A vocabulary of ranks: ids of texts, and bytes of ids."""

    def __init__(self, entries: list[bytes], ids: list[int], kept_misses: int = 600_000):
        self._hash = PerfectHash(entries)
        self._ids = np.array(ids, np.int64)
        rank = dict(zip(entries, ids))
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self._byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        self._first_pairs = np.array([[rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        # every way to make an entry of two others
        self._pair = {
            a << 32 | b: joined
            for entry, joined in rank.items()
            for k in range(1, len(entry))
            if (a := rank.get(entry[:k])) is not None and (b := rank.get(entry[k:])) is not None
        }
        self._entry_of = np.full(max(ids) + 1, -1, np.int64)
        self._entry_of[ids] = np.arange(len(ids))
        self._entries = pa.array(entries, pa.large_binary())
        self._misses: dict[bytes, bytes] = {}
        self._kept = kept_misses

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids (u32) of each word: the pair of lowest rank is joined first, the leftmost of several.

        The pairs of bytes that begin each word's heap are looked up for all words
        at once; in order they are a heap already.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        rank = np.full(len(flat), -1, np.int64)
        rank[:-1] = self._first_pairs[flat[:-1], flat[1:]]
        rank[ends - 1] = -1
        at = np.flatnonzero(rank >= 0)
        owner = np.repeat(np.arange(len(words)), sizes)[at]
        top = rank[at] << 32 | (at - (ends - sizes)[owner])
        tops = top[np.lexsort((top, owner))].tolist()
        until = np.searchsorted(owner, np.arange(1, len(words) + 1)).tolist()
        ids, wanted = self._byte[flat].tolist(), rank.tolist()
        out, begin, first = [], 0, 0
        for end, last in zip(ends.tolist(), until):
            out.append(self._merge(ids[begin:end], wanted[begin:end], tops[first:last]))
            begin, first = end, last
        return out

    def _merge(self, ids: list[int], wanted: list[int], heap: list[int]) -> bytes:
        """``ids`` of bytes, the rank ``wanted`` at each place (-1: none) and its heap (rank, place)."""
        pair, n = self._pair.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            top = _pop(heap)
            joined, k = top >> 32, top & _LOW
            # parts that have been joined since make the entry stale
            if wanted[k] != joined:
                continue
            gone = after[k]
            after[k] = stop = after[gone]
            ids[k] = joined
            ids[gone] = wanted[gone] = -1
            before[stop] = k
            if stop < n:
                wanted[k] = r = pair(joined << 32 | ids[stop], -1)
                if r >= 0:
                    _push(heap, r << 32 | k)
            else:
                wanted[k] = -1
            ahead = before[k]
            if ahead >= 0:
                wanted[ahead] = r = pair(ids[ahead] << 32 | joined, -1)
                if r >= 0:
                    _push(heap, r << 32 | ahead)
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def _resolve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (u32) of all ``words`` one after the other, and how many each has."""
        entry = self._hash.find(words)
        counts = np.ones(len(words), np.int64)
        missed = np.flatnonzero(entry < 0)
        known = self._misses
        rare = [words[k] for k in missed.tolist()]
        new = [w for w in rare if w not in known]
        if len(known) + len(new) > self._kept:
            known.clear()
            new = rare
        known.update(zip(new, self.merged(new)))
        parts = [known[w] for w in rare]
        counts[missed] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        hit = entry >= 0
        flat = np.empty(int(counts.sum()), "<u4")
        tier_one = np.repeat(hit, counts)
        flat[tier_one] = self._ids[entry[hit]]
        flat[~tier_one] = np.frombuffer(b"".join(parts), "<u4")
        return flat, counts

    def encode(self, texts: list[str], most: int = 1 << 22) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            words, per_text = pre_tokens(held)
            coded = words.dictionary_encode()
            flat, counts = self._resolve(coded.dictionary.cast(pa.binary()).to_pylist())
            first = np.cumsum(counts) - counts
            at = coded.indices.to_numpy()
            many = counts[at]
            stops = np.cumsum(many)
            # the j-th id of a text is the flat id of its word, moved on within the word
            ids = flat[np.arange(len(flat) and int(many.sum())) + np.repeat(first[at] - (stops - many), many)]
            edges = np.append(0, stops)[np.append(0, np.cumsum(per_text))]
            for k, a, b in zip(owners, edges[:-1].tolist(), edges[1:].tolist()):
                out[k] += ids[a:b].tobytes()

        for k, text in enumerate(texts):
            for part in _cut(text, most) if len(text) > most else (text,):
                held.append(part)
                owners.append(k)
                size += len(part)
                if size >= most:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return out

    def decode(self, codes: list[bytes]) -> list[bytes]:
        """Bytes of little-endian u32 ids; an id outside the vocabulary raises ValueError."""
        ids = np.frombuffer(b"".join(codes), "<u4")
        if len(ids) == 0:
            return [b""] * len(codes)
        entry = self._entry_of[np.minimum(ids, len(self._entry_of) - 1)]
        if int(ids.max()) >= len(self._entry_of) or (entry < 0).any():
            raise ValueError("an id that is not in the vocabulary")
        parts = self._entries.take(pa.array(entry))
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[: len(ids) + 1]
        data = parts.buffers()[2].to_pybytes()
        edges = offsets[np.cumsum([0, *(len(c) // 4 for c in codes)])].tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    """Entries and ranks of a rank file: base64 text and a number on each line."""
    with open(path, "rb") as lines:
        rows = [line.split() for line in lines if line.strip()]
    return [base64.b64decode(a) for a, _ in rows], [int(b) for _, b in rows]


def _shared(df: DataFrame, path: str):
    """The vocabulary on every worker, built there once from a broadcast of the rank file's rows."""
    entries, ids = read_ranks(path)
    # a vocabulary is a few hundred thousand entries at most, whatever the data
    if len(entries) > 2_000_000:
        raise ValueError("a vocabulary of over 2,000,000 entries")
    sent = df.sparkSession.sparkContext.broadcast((entries, ids))

    def vocabulary() -> BytePairs:
        if path not in _BUILT:
            _BUILT[path] = BytePairs(*sent.value)
        return _BUILT[path]

    return vocabulary


_BUILT: dict[str, BytePairs] = {}
_OUT_BYTES = 8 << 20


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Neighbouring rows of about 8 MB in all, or a single larger row."""
    at = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= _OUT_BYTES:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode_texts(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, token_ids): ids of whole texts, as little-endian u32 bytes.

    ``ranks``: path of a rank file, read on the driver.  ``PATTERN`` splits texts
    and each match is encoded by itself.  No special tokens.  A null or empty text has no
    ids; every row gives one row, repeated and null ids too; other columns are
    ignored; an empty table gives an empty result.
    """
    vocabulary = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary().encode
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for some in _slices(pa.compute.binary_length(texts).to_pylist()):
                codes = encode(texts[some].to_pylist())
                yield pa.record_batch(
                    [batch.column(0)[some], pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary())],
                    [id_col, "n_tokens", "token_ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, token_ids binary")


def decode_texts(encoded: DataFrame, ranks: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out``, the bytes of its ids.

    Null ids give null bytes.  An id that is not in the vocabulary fails the job;
    bytes may be no valid text if ids were cut, so they stay binary.  A column
    named ``out`` is refused.
    """
    if out in encoded.columns:
        raise ValueError(f"there is a column {out} already")
    vocabulary = _shared(encoded, ranks)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + [f"`{out}` binary"])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary().decode
        for batch in batches:
            codes = batch.column(at)
            for some in _slices(pa.compute.fill_null(pa.compute.binary_length(codes), 0).to_pylist()):
                raw = codes[some].to_pylist()
                back = [None if c is None else d for c, d in zip(raw, decode([c or b"" for c in raw]))]
                columns = [c[some] for c in batch.columns]
                yield pa.record_batch([*columns, pa.array(back, pa.binary())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)
