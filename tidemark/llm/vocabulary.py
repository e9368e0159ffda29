"""Words as small integers, for numpy work on whole batches of text, and what workers keep between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What tasks of ``owner`` keep in a worker process; tasks of other owners empty it."""
    return _CACHES.setdefault(owner, {})


def _begin_task(owner: str) -> None:
    for other, cache in _CACHES.items():
        if other != owner:
            cache.clear()


def _end_task() -> None:
    pa.default_memory_pool().release_unused()


def lean(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, leaving little behind in its worker, which outlives tasks and stages."""

    def task(batches: Iterator) -> Iterator:
        _begin_task(owner)
        try:
            yield from run(batches)
        finally:
            _end_task()

    return task


class Vocabulary(dict):
    """word -> number, with a row of properties for each word found by ``describe``.

    Lives in one worker process and is emptied between batches once it holds
    ``most`` words, which changes speed but no result.
    """

    def __init__(self, describe: Callable[[str], tuple[int, ...]], width: int, kind=np.uint64, most: int = 500_000):
        super().__init__()
        self._describe, self._width, self._kind, self._most = describe, width, kind, most
        self._new: list[tuple[int, ...]] = []
        self._table = np.empty((1024, width), kind)
        self._filled = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = self._filled + len(self._new)
        self._new.append(self._describe(word))
        return number

    def between_batches(self) -> None:
        if len(self) > self._most:
            self.clear()
            self._new.clear()
            self._filled = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        """Properties of all words so far, one row each; the array doubles as it fills."""
        end = self._filled + len(self._new)
        if end > len(self._table):
            grown = np.empty((max(end, 2 * len(self._table)), self._width), self._kind)
            grown[: self._filled] = self._table[: self._filled]
            self._table = grown
        if self._new:
            self._table[self._filled : end] = self._new
            self._filled = end
            self._new.clear()
        return self._table[:end]
