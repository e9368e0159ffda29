"""Spelling variants: words one edit apart, found with blocked Gram matrices.

A word is its letter counts.  Two words one inserted, deleted or replaced letter
apart have counts at a squared distance of 1 or 2, and squared distances of whole
blocks are one NumPy product.  Blocks are words of one length with the same
counts in a few groups of letters; one edit moves a word to the same block or to
a known neighbour, of the same or the next length, so products of neighbouring
blocks miss no pair.  Spark deals coarse blocks (four groups of letters) to
tasks; a task forms products of its fine blocks (eight groups).  Blocks are cut
into bounded chunks on either side, and pairs at a squared distance of at most
two are checked letter by letter.  A task passes on counts and the best near
word, never pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop_written, written

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
_SHORT = 64

# English letters by frequency; a group takes every eighth, so groups are of like weight
_BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
_FINE, _COARSE = 8, 4


def letter_groups() -> list[str]:
    """Letters of each fine group; fine groups 2k and 2k + 1 make up coarse group k.

    Letters outside this list (anything but a-z and U+00C0 to U+00FF) belong to
    the last group.
    """
    letters = _BY_FREQUENCY + "".join(map(chr, range(0xC0, 0x100)))
    return ["".join(c for k, c in enumerate(letters) if k % _FINE == g) for g in range(_FINE)]


def letter_runs(text: np.ndarray, begins: np.ndarray, window: int = 1 << 22) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Runs of letters in UTF-8 bytes, A-Z in lower case, with the number of the text they stand in.

    ``text`` holds texts one after the other, which begin at ``begins``; no run
    crosses from one text to the next.  Works on windows of bytes that grow only
    for a run longer than a window.
    """
    at, size = 0, window
    while at < len(text):
        part = _LOWER[text[at : at + size]]
        # U+00C0 to U+00FF are the byte C3 and one more
        high = part == 0xC3
        letter = _ASCII_LETTER[part] | high
        letter[1:] |= high[:-1]
        opens = letter.copy()
        opens[1:] &= ~letter[:-1]
        inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(part))] - at
        opens[inside] = letter[inside]
        starts = np.flatnonzero(opens)
        done = at + len(part) == len(text)
        if not done and len(starts) < 2 and len(starts) and letter[-1]:
            if starts[0] == 0:
                size *= 2
                continue
        if not done and len(starts) and letter[starts[-1] :].all():
            # the last run may go on: read it again with the next window
            part, letter, end = part[: starts[-1]], letter[: starts[-1]], at + int(starts[-1])
            starts = starts[:-1]
        else:
            end = at + len(part)
        if len(starts):
            before = np.cumsum(letter, dtype=np.int32)
            offsets = np.append(before[starts] - 1, before[-1]).astype(np.int32)
            data = part[letter].tobytes()
            runs = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield runs, np.searchsorted(begins, at + starts, side="right") - 1
        at, size = end, window


def _shifted(prefix: int, sizes: np.ndarray) -> np.ndarray:
    """``prefix`` (a crc32) moved on by each of ``sizes`` zero bytes, without their own checksum."""
    zeros = [bytes(s) for s in sizes.tolist()]
    return np.array([zlib.crc32(z, prefix) ^ zlib.crc32(z) for z in zeros], np.uint32)


def count_words(
    docs: DataFrame, drop_every: int | None = 97, id_col: str = "doc_id", text_col: str = "text", least: int = 3, least_letters: int = 5
) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case.

    With ``drop_every``, a run whose h = crc32(``<id>:<run>``) it divides loses its
    letter h % length, which plants misspellings that any engine can repeat.
    Only words of ``least_letters`` letters and ``least`` occurrences are kept.  A
    null text has no runs, a null id counts as empty text, and every row of the
    table counts, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").cast(pa.large_utf8())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if len(texts) == 0 or offsets[0] == offsets[-1]:
                continue
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            # an empty text begins where the next one does, which then is the last of them
            begins = offsets[:-1] - offsets[0]
            found = list(letter_runs(raw, begins))
            if not found:
                continue
            coded = pa.chunked_array([runs for runs, _ in found]).dictionary_encode().combine_chunks()
            k, words = coded.indices.to_numpy(), coded.dictionary
            n = np.bincount(k, minlength=len(words))
            cut: Counter = Counter()
            if drop_every is not None:
                byte_counts = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1])
                # very long words are hashed one by one
                sizes, place = np.unique(np.minimum(byte_counts, _SHORT), return_inverse=True)
                own = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint32, len(words))
                prefixes = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
                owner = np.concatenate([o for _, o in found])
                for at in range(0, len(k), 1 << 20):
                    some, of = k[at : at + (1 << 20)], owner[at : at + (1 << 20)]
                    table = np.array([_shifted(prefixes[o], sizes) for o in range(of[0], of[-1] + 1)])
                    h = table[of - of[0], place[some]] ^ own[some]
                    for j in np.flatnonzero(byte_counts[some] > _SHORT).tolist():
                        h[j] = zlib.crc32(words[int(some[j])].as_py().encode(), prefixes[of[j]])
                    hit = np.flatnonzero(h % np.uint32(drop_every) == 0)
                    np.subtract.at(n, some[hit], 1)
                    for word, code in zip(words.take(pa.array(some[hit])).to_pylist(), h[hit].tolist()):
                        gone = code % len(word)
                        cut[word[:gone] + word[gone + 1 :]] += 1
            left = np.flatnonzero(n)
            yield pa.record_batch([words.take(pa.array(left)), pa.array(n[left], pa.int64())], ["word", "n"])
            yield pa.record_batch([pa.array(list(cut), pa.string()), pa.array(list(cut.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return (
        counted.where(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
    )


def _coarse_key() -> Column:
    """Numbers of letters in each coarse group, as an array."""
    groups = letter_groups()
    count = []
    for k in range(_COARSE - 1):
        letters = groups[2 * k] + groups[2 * k + 1]
        count.append(F.length("word") - F.length(F.translate("word", letters, "")))
    rest = F.length("word")
    for c in count:
        rest = rest - c
    return F.array(*count, rest)


def _moved(key: Column, up: int | None, down: int | None) -> Column:
    return F.array(*[key[k] + int(k == up) - int(k == down) for k in range(_COARSE)])


def _dealt(words: DataFrame, chunk_words: int, right_words: int) -> DataFrame:
    """Rows (letters, key, chunk, slice, word, n, is_left) of all groups of neighbouring blocks."""
    rows = written(words.withColumns({"letters": F.length("word"), "key": _coarse_key()}), "keyed-words")
    # a word of many letters takes the room of several
    room = F.ceil(F.greatest(F.lit(1.0), F.col("letters") / 64))
    blocks = rows.groupBy("letters", "key").agg(F.count(F.lit(1)).alias("inside")).withColumn("weight", F.col("inside") * room)
    blocks = written(blocks.withColumn("chunks", F.ceil(F.col("weight") / chunk_words)), "word-blocks")
    # the left blocks whose words this block's words are compared with: of the same
    # length (one letter replaced by one of a later group), or one letter shorter
    key = F.col("key")
    same = [_moved(key, a, b) for a in range(_COARSE) for b in range(a + 1, _COARSE)]
    shorter = [_moved(key, None, a) for a in range(_COARSE)]
    to = F.array(
        F.struct(F.col("letters").alias("letters"), key.alias("key")),
        *[F.struct(F.col("letters").alias("letters"), k.alias("key")) for k in same],
        *[F.struct((F.col("letters") - 1).alias("letters"), k.alias("key")) for k in shorter],
    )
    links = (
        blocks.select(F.col("letters").alias("of_letters"), key.alias("of_key"), "weight", F.explode(to).alias("to"))
        .where(F.array_min("to.key") >= 0)
        .select("of_letters", "of_key", "weight", "to.letters", "to.key")
        .join(blocks.select("letters", "key", "chunks"), ["letters", "key"])
    )
    total = links.groupBy("letters", "key").agg(F.ceil(F.sum("weight") / right_words).alias("slices"))
    goals = (
        links.join(total, ["letters", "key"])
        .groupBy("of_letters", "of_key")
        .agg(F.collect_list(F.struct("letters", "key", "chunks", "slices")).alias("goals"))  # eleven at most
    )
    placed = rows.join(
        goals.select(F.col("of_letters").alias("letters"), F.col("of_key").alias("key"), "goals"), ["letters", "key"]
    ).withColumns({"hash": F.xxhash64("word"), "hash2": F.xxhash64(F.lit(2), "word")})
    to = placed.select("word", "n", "hash", "hash2", F.explode("goals").alias("g"), (F.col("letters") == F.col("g.letters")) & (F.col("key") == F.col("g.key")))
    to = to.toDF("word", "n", "hash", "hash2", "g", "own").withColumn(
        "at", F.when(F.col("own"), F.pmod("hash", F.col("g.chunks")))
    )
    left = to.where("own").select(
        "g.letters", "g.key", F.col("at").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.slices") - 1)).alias("slice"), "word", "n", F.lit(True).alias("is_left")
    )
    # within its own block a word goes to the chunks before its own: each pair meets once
    last = F.when(F.col("own"), F.col("at")).otherwise(F.col("g.chunks")) - 1
    right = to.where(last >= 0).select(
        "g.letters", "g.key", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), F.pmod("hash2", F.col("g.slices")).alias("slice"), "word", "n", F.lit(False).alias("is_left")
    )
    return left.unionByName(right)


def _fine_weights() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 62, _FINE, dtype=np.int64)


def _code_points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)


def _one_edit(words: np.ndarray, a: np.ndarray, b: np.ndarray, letters: int) -> np.ndarray:
    """Which pairs differ in exactly one letter; b has ``letters`` letters as a has, or one more."""
    out = np.zeros(len(a), bool)
    step = max(1, 2_000_000 // (letters + 1))
    for at in range(0, len(a), step):
        some = slice(at, at + step)
        x = _code_points([words[k] for k in a[some].tolist()], letters + 1)
        y = _code_points([words[k] for k in b[some].tolist()], letters + 1)
        apart = x[:, :letters] != y[:, :letters]
        equal_length = y[:, letters] == 0
        replaced = apart.sum(axis=1) == 1
        # from the first difference on, the longer word is the shorter one moved by one
        behind = np.logical_or.accumulate(apart, axis=1)
        inserted = ~(behind & (x[:, :letters] != y[:, 1:])).any(axis=1)
        out[some] = np.where(equal_length, replaced, inserted)
    return out


def near_in_blocks(words: list[str], is_left: np.ndarray, letters: int, together: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, other) one edit apart; ``together`` asks for pairs of left words too.

    Left words have ``letters`` letters, the others as many or one more.
    """
    none = np.empty(0, np.int64)
    if not is_left.any() or len(words) < 2:
        return none, none
    groups = np.full(0x110000 if letters > 1_000_000 else 256, _FINE - 1, np.int64)
    for g, text in enumerate(letter_groups()):
        for c in text:
            groups[ord(c)] = g
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    used, column = np.unique(flat, return_inverse=True)
    kind = np.float32 if letters < 4000 else np.float64  # exact whole numbers either way
    width = len(used)
    counts = np.bincount(owner * width + column, minlength=len(words) * width).reshape(-1, width).astype(kind)
    half = (counts * counts).sum(axis=1) / 2
    ones = np.ones(len(words), kind)
    # left row times right row is 1 - (squared distance) / 2
    left_rows = np.column_stack([counts, 1 - half, ones])
    right_rows = np.column_stack([counts, ones, -half])
    weights = _fine_weights()
    group_of = weights[np.where(used < 256, groups[np.minimum(used, 255)], _FINE - 1)]
    code = np.zeros(len(words), np.int64)
    with np.errstate(over="ignore"):
        np.add.at(code, owner, group_of[column])
        code += np.where(sizes > letters, np.int64(1) << 61, 0)
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    ends = np.append(first[1:], len(order))
    left_codes = np.unique(code[is_left])
    # one letter of group i replaced by one of group j: of a later coarse group, or of the same
    replaced = [weights[j] - weights[i] for i in range(_FINE) for j in range(_FINE) if i != j and i // 2 <= j // 2]
    longer = [w + (np.int64(1) << 61) for w in weights]
    with np.errstate(over="ignore"):
        goal = left_codes[:, None] + np.array([0, *replaced, *longer], np.int64)[None, :]
    place = np.minimum(np.searchsorted(codes, goal), len(codes) - 1)
    found = codes[place] == goal
    own = np.searchsorted(codes, left_codes)
    a_parts, b_parts = [], []
    for k in range(len(left_codes)):
        mine = order[first[own[k]] : ends[own[k]]]
        mine = mine[is_left[mine]]
        other = np.concatenate([order[first[p] : ends[p]] for p in place[k][found[k]]])
        if not together:
            other = other[~is_left[other]]
        across = right_rows[other].T
        step = max(1, 4_000_000 // max(len(other), 1))
        for at in range(0, len(mine), step):
            close = (left_rows[mine[at : at + step]] @ across) >= 0
            x, y = np.nonzero(close)
            x, y = mine[at + x], other[y]
            # two left words meet from either side
            keep = ~is_left[y] | (x < y)
            a_parts.append(x[keep])
            b_parts.append(y[keep])
    a, b = np.concatenate(a_parts), np.concatenate(b_parts)
    good = _one_edit(words, a, b, letters)
    return a[good], b[good]


def near_words(words: DataFrame, chunk_words: int = 8192, right_words: int = 65_536) -> DataFrame:
    """(word, n_near, best_n, best_word) of each word with near words.

    ``words``: distinct ``word`` (not null) with occurrences ``n``.  ``best_word``
    is the near word with most occurrences, the smallest of several.
    """

    def compare(group: pa.Table) -> pa.Table:
        words, n = group.column("word").to_pylist(), group.column("n").to_numpy()
        is_left = group.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
        letters, slice_ = group.column("letters")[0].as_py(), group.column("slice")[0].as_py()
        a, b = near_in_blocks(words, is_left, letters, slice_ == 0)
        at, to = np.concatenate([a, b]), np.concatenate([b, a])
        # best first: most occurrences, then the smallest word
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
        sort = np.lexsort((rank[to], at))
        at, to = at[sort], to[sort]
        who, first, many = np.unique(at, return_index=True, return_counts=True)
        best = to[first]
        return pa.table(
            {
                "word": pa.array([words[k] for k in who.tolist()], pa.string()),
                "near": pa.array(many, pa.int64()),
                "best_n": pa.array(n[best], pa.int64()),
                "best_word": pa.array([words[k] for k in best.tolist()], pa.string()),
            }
        )

    found = (
        _dealt(words, chunk_words, right_words)
        .groupBy("letters", "key", "chunk", "slice")
        .applyInArrow(compare, "word string, near long, best_n long, best_word string")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word"))).alias("best")
    return (
        found.groupBy("word")
        .agg(F.sum("near").alias("n_near"), best)
        .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best_word"))
    )


def spelling_variants(words: DataFrame, ratio: int = 2, chunk_words: int = 8192, right_words: int = 65_536) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (distinct word, n).

    ``form`` is the near word with most occurrences (the smallest of several) if
    it has at least ``ratio`` (2 or more) times the word's own, else null; ``root``
    is the last word on the way along forms, the word itself if it has none.
    Null words are left out, other columns ignored; an empty table gives an empty
    result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms cannot turn in circles")
    words = written(words.where(F.col("word").isNotNull()).select("word", "n"), "words")
    near = near_words(words, chunk_words, right_words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    table = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best_word")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
            F.coalesce(F.when(is_form, F.col("best_word")), F.col("word")).alias("root"),
        ),
        "forms",
    )
    # each round doubles the way: the root of the root
    while True:
        up = table.where(F.col("form").isNotNull()).select(F.col("word").alias("_of"), F.col("root").alias("_up"))
        ahead = written(table.join(up, F.col("root") == F.col("_of"), "left"), "forms")
        moved = ahead.where(F.col("_up").isNotNull()).limit(1).count()
        drop_written(table)
        table = ahead.withColumn("root", F.coalesce("_up", "root")).drop("_of", "_up")
        table._tidemark_path = ahead._tidemark_path
        if moved == 0:
            return table.select("word", "n", "n_near", "form", "form_n", "root")
