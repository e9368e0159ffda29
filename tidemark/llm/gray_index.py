"""A hierarchical index over 64-bit fingerprints in Gray order, in numpy.

Fingerprints of one group are sorted by Gray rank, so that neighbours differ in
few bits.  Runs of ``FANOUT`` neighbours form a node, runs of nodes an upper
node, up to one root.  A node keeps the bits that all its members share (mask
and pattern).  A search walks pairs of nodes from the root down and carries the
number of differing bits among those that both nodes share; a child adds only
the bits that its parent did not fix.  Pairs above the limit are pruned with all
their members; pairs that cannot exceed it are accepted with all their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
MOST_PAIRS = 1 << 19  # pairs of nodes expanded at once: bounds a task's memory


class GrayIndex:
    """Index of ``codes``, sorted by group and then by Gray rank."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """``starts``: the first position of each group."""
        n = len(codes)
        sizes = np.diff(np.append(starts, n))
        first, shared, varies = np.arange(n), codes, np.zeros(n, np.uint64)
        ends = first + 1
        either = codes
        self.levels = [(first, ends, shared, varies)]
        group_first, group_size = starts, sizes
        while True:
            if (group_size <= 1).all():
                break
            within = np.arange(len(shared)) - np.repeat(group_first, group_size)
            at = np.flatnonzero(within % FANOUT == 0)
            shared = np.bitwise_and.reduceat(shared, at)
            either = np.bitwise_or.reduceat(either, at)
            self.levels.append((at, np.append(at[1:], len(within)), shared, shared ^ either))
            group_size = -(-group_size // FANOUT)
            group_first = np.concatenate(([0], np.cumsum(group_size)[:-1]))

    def _members(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = node, node + 1
        for k in range(level, 0, -1):
            starts, ends = self.levels[k][:2]
            first, last = starts[first], ends[last - 1]
        return first, last

    def links(self, limit: int, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays (i, j, distance) of positions linked at ``limit`` bits or fewer.

        With ``exact`` every linked pair comes once with its distance.  Without,
        groups accepted as a whole come as a star around their first member,
        which links the same positions into the same components.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][2]))
        zero = np.zeros(len(roots), np.uint64)
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), zero)]
        while stack:
            level, left, right, found, fixed = stack.pop()
            if level == 0:
                apart = left != right
                if apart.any():
                    yield left[apart], right[apart], found[apart]
                continue
            starts, ends = self.levels[level][:2]
            na, nb = ends[left] - starts[left], ends[right] - starts[right]
            total = np.cumsum(na * nb)
            if len(left) > 1 and total[-1] > MOST_PAIRS:
                cut = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(left) - 1)
                for part in (slice(cut, None), slice(None, cut)):
                    stack.append((level, left[part], right[part], found[part], fixed[part]))
                continue
            of = np.repeat(np.arange(len(left)), na * nb)
            step = np.arange(total[-1]) - np.repeat(total - na * nb, na * nb)
            i, j = starts[left][of] + step // nb[of], starts[right][of] + step % nb[of]
            once = (left != right)[of] | (i <= j if level > 1 else i < j)
            i, j, of = i[once], j[once], of[once]
            _, _, shared, varies = self.levels[level - 1]
            loose = varies[i] | varies[j]
            now = ~loose
            more = (shared[i] ^ shared[j]) & now & ~fixed[of]
            differ = found[of] + np.bitwise_count(more)
            near = differ <= limit
            i, j, differ, now, loose = i[near], j[near], differ[near], now[near], loose[near]
            if not exact and level > 1:
                whole = differ + np.bitwise_count(loose) <= limit
                if whole.any():
                    yield from self._whole(level - 1, i[whole], j[whole], limit)
                    i, j, differ, now = i[~whole], j[~whole], differ[~whole], now[~whole]
            if len(i):
                stack.append((level - 1, i, j, differ, now))

    def _whole(self, level, i, j, limit):
        centre = self._members(level, i)[0]
        for side in (i, j):
            first, last = self._members(level, side)
            size = last - first
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            hub = np.repeat(centre, size)
            apart = hub != member
            yield hub[apart], member[apart], np.full(apart.sum(), limit)
