"""Benchmark decontamination by template windows.

Text becomes a run of tokens in which numbers, names and units are typed
placeholders, so that a question with other numbers or names keeps its template.
Windows of template tokens (of the words themselves where a window is mostly
placeholders) are hashed and joined with those of the benchmark; the
values that fill the placeholders must then map one to one between document and
item along each alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.storage import free_names, written
from tidemark.llm.vocabulary import Vocabulary, lean

# fixed values: unit words and signs that follow a number
UNITS = frozenset(
    """mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms kb mb gb tb w kw mw v hz
    millimeters centimeters meters metres kilometers kilometres inches feet yards miles grams kilograms
    tons ounces pounds liters litres gallons seconds minutes hours days weeks months years percent dollars
    euros cents degrees % $ € £ °c °f""".split()
)
_NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*\Z")
_MEASURE = re.compile(r"[+\-$€£]?\d[\d.,:/]*([^\W\d_]+|%|°[cCfF])\Z")
_CORE = re.compile(r"[^\W_].*[^\W_%]|[^\W_]", re.S)
_NONE, _LITERAL, _NUM, _MEAS, _NAME = range(5)
_NAMES = {_NUM: "number", _MEAS: "measure", _NAME: "name", 5: "unit"}


def _describe(word: str) -> tuple[int, ...]:
    """(literal code, kind inside a sentence, is a unit, ends a sentence)."""
    if word.isalpha():
        core = word
    elif word[:-1].isalpha() and word[-1] in ",.;:!?" and word not in UNITS:
        core = word[:-1]
    else:
        found = _CORE.search(word)
        core = word if word in UNITS else found.group(0) if found else ""
    if not core:
        return 0, _NONE, 0, int(word[-1:] in ".!?:")
    kind = _LITERAL
    if not core[0].isalpha() and _NUMBER.match(core):
        kind = _NUM
    elif not core[0].isalpha() and _MEASURE.match(core):
        kind = _MEAS
    elif len(core) > 1 and core[0].isupper() and core[1:].islower():
        kind = _NAME
    low = core.lower()
    return xxh64_intdigest(low, 1) | 1, kind, int(low in UNITS), int(word[-1:] in ".!?:")


_PLACE = {k: np.uint64(xxh64_intdigest(name, 2) | 1) for k, name in _NAMES.items()}
_EXACT = np.uint64(xxh64_intdigest("exact", 2))
_FACTORS = np.array([xxh64_intdigest(str(k), 3) | 1 for k in range(256)], np.uint64)


class Templates:
    """Template windows of texts; one per worker process."""

    def __init__(self):
        self.words = Vocabulary(_describe, 4)

    def tokens(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, template codes, word codes and kinds (1 literal, else a placeholder) without bare punctuation."""
        words = (text or "").split()
        row = self.words.numbers(words)
        if len(row) == 0:
            return words, np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        code, kind, unit, stop = self.words.table()[row].T
        start = np.append(True, stop[:-1] > 0)
        kind = kind.astype(np.int64)
        kind[start & (kind == _NAME)] = _LITERAL
        after = np.append(False, kind[:-1] == _NUM)
        kind[after & (unit > 0)] = 5
        plain, code = code, code.copy()
        for k, place in _PLACE.items():
            code[kind == k] = place
        some = np.flatnonzero(kind != _NONE)
        return [words[i] for i in some] if len(some) < len(words) else words, code[some], plain[some], kind[some]

    @staticmethod
    def windows(code, plain, kind, size: int, least_literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of the windows of ``size`` tokens, and which of them are exact.

        A window with enough literal tokens is hashed as a template, another one by its words.
        """
        n = len(code) - size + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        literal = np.cumsum(np.append(0, kind == _LITERAL))
        exact = literal[size:] - literal[:-size] < least_literal
        hashed = np.where(exact, _EXACT, np.uint64(size))
        for k in range(size):
            hashed += np.where(exact, plain[k : k + n], code[k : k + n]) * _FACTORS[k]
        hashed ^= hashed >> np.uint64(29)
        hashed *= _FACTORS[255]
        return np.arange(n), hashed, exact


def _slots(words: list[str], kind: np.ndarray, begin: int, size: int) -> list[str]:
    return [f"{_NAMES[int(kind[k])]}={_clean(words[k])}" for k in range(begin, begin + size) if kind[k] != _LITERAL]


def _clean(word: str) -> str:
    found = _CORE.search(word)
    return (found.group(0) if found else word).lower()


_WINDOW_SCHEMA = "window long, size int, place int, exact boolean, templates int, windows int, slots array<string>"


def _template_windows(rows: DataFrame, sizes: list[int], share_literal: float, wanted, whole: bool) -> DataFrame:
    """(id, window, size, place, exact, templates, windows, slots); only windows in ``wanted`` (sorted) if given.

    ``whole``: a text with fewer tokens than the largest size gives one window of all of them.
    """
    kind_id = rows.schema.fields[0].dataType.simpleString()
    names = ["id", "window", "size", "place", "exact", "templates", "windows", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        known = wanted.value if wanted is not None else None
        for batch in batches:
            templates.words.between_batches()
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, code, plain, kind = templates.tokens(text)
                mine = [min(len(code), max(sizes))] if whole else sizes
                for size in mine:
                    if size == 0:
                        continue
                    at, hashed, exact = templates.windows(code, plain, kind, size, int(np.ceil(share_literal * size)))
                    total, loose = len(at), len(at) - int(exact.sum())
                    if known is not None:
                        spot = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                        hit = known[spot] == hashed
                        at, hashed, exact = at[hit], hashed[hit], exact[hit]
                    for k, h, e in zip(at.tolist(), hashed.view(np.int64).tolist(), exact.tolist()):
                        slots = [] if e else _slots(words, kind, k, size)
                        for column, value in zip(out, (doc, h, size, k, e, loose, total, slots)):
                            column.append(value)
                if len(out[0]) >= 20_000:
                    yield _batch(out, batch.schema.field(0).type, names)
                    out = [[] for _ in names]
            if out[0]:
                yield _batch(out, batch.schema.field(0).type, names)

    return rows.mapInArrow(lean(run), f"id {kind_id}, {_WINDOW_SCHEMA}")


def _batch(out: list[list], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    return pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window_words: int = 8,
    share_literal: float = 0.5,
    min_share: float = 0.3,
    broadcast_windows: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, matched, windows, share): documents that hold a benchmark item.

    ``matched`` of the item's ``windows`` occur in the document on alignments
    whose placeholder values map one to one; a pair is given from ``min_share``
    on.  A window with fewer literal tokens than ``share_literal`` of them is no
    template: it must occur word by word.  The share is the larger one of the
    item's templates alone and of all its windows; ``matched`` and ``windows``
    are those of that share.  Items shorter than a window are one window of
    their whole length, however short.

    The benchmark's window hashes go to the workers when there are at most
    ``broadcast_windows`` of them (8 bytes each); beyond that all document
    windows are shuffled into the join.  Both ways give the same rows.

    Null or empty texts on either side match nothing.  Rows with the same id
    count as one document or item; a null document id is one document.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    known = written(
        _template_windows(items, [window_words], share_literal, None, whole=True).withColumnsRenamed(
            {"id": "item_id", "slots": "item_slots", "place": "item_place"}
        ),
        "benchmark-windows",
    )
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most window_words rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = None
    if known.count() <= broadcast_windows:
        codes = known.select("window").distinct().toPandas()["window"].to_numpy(np.int64).view(np.uint64)
        if len(codes) == 0:
            codes, sizes = np.zeros(1, np.uint64), [window_words]
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(codes))
    found = _template_windows(rows, sizes, share_literal, wanted, whole=False).drop("templates", "windows")
    pairs = found.join(known, ["window", "size", "exact"]).where(F.size("slots") == F.size("item_slots"))
    by_line = written(
        pairs.groupBy("id", "item_id", "templates", "windows", (F.col("place") - F.col("item_place")).alias("shift")).agg(
            F.collect_set(F.struct("item_place", "exact")).alias("places"),
            F.array_distinct(
                F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("now"))))
            ).alias("filled"),
        ),
        "alignments",
    )
    same = (F.size("filled") == F.size(F.array_distinct("filled.was"))) & (
        F.size("filled") == F.size(F.array_distinct("filled.now"))
    )
    return (
        by_line.where(same)
        .select("id", "item_id", "templates", "windows", F.explode("places").alias("place"))
        .groupBy("id", "item_id")
        .agg(
            F.count_distinct(F.when(~F.col("place.exact"), F.col("place.item_place"))).alias("loose"),
            F.count_distinct("place.item_place").alias("all"),
            F.max("templates").cast("long").alias("templates"),
            F.max("windows").cast("long").alias("windows"),
        )
        .withColumn("by_all", (F.col("templates") == 0) | (F.col("all") * F.col("templates") > F.col("loose") * F.col("windows")))
        .select(
            "id",
            "item_id",
            F.when(F.col("by_all"), F.col("all")).otherwise(F.col("loose")).alias("matched"),
            F.when(F.col("by_all"), F.col("windows")).otherwise(F.col("templates")).alias("windows"),
        )
        .withColumn("share", F.col("matched") / F.col("windows"))
        .where(F.col("share") >= min_share)
        .withColumnRenamed("id", "doc_id")
    )


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that ``find_leaks`` names."""
    (name,) = free_names(docs, "_gone")
    gone = leaks.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
