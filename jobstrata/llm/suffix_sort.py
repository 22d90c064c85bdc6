"""Sorting of suffixes by hash comparison, for all groups of a batch at once.

Two suffixes are compared by the length of their common extension, found by binary search over prefix polynomial hashes,
and the byte after it: a logarithmic number of hash probes instead of one per byte. The sort is a bottom-up merge sort;
each level ranks every suffix in its neighbour block by binary search. Since unequal hashes prove unequal bytes, only a
false equality can go wrong; the byte order of neighbours in the result is verified, and a failure starts over with
another hash.
"""

from __future__ import annotations

import numpy as np

from jobstrata.llm.polyhash import PolyHash

_HASHES: dict[int, PolyHash] = {}
_SLICE = 1 << 14


def _hash(seed: int) -> PolyHash:
    return _HASHES.setdefault(seed, PolyHash(seed))


class Suffixes:
    """Suffixes of ``data``, each cut off after ``limit`` bytes."""

    def __init__(self, data: np.ndarray, limit: int, seed: int = 101):
        self.data, self.limit, self.hash = data, limit, _hash(seed)
        self.sums = self.hash.prefix(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b`` that the hashes show."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.limit, np.int64)
        inverse = self.hash.powers(len(self.sums))[1]
        with np.errstate(over="ignore"):
            while (low < high).any():
                mid = (low + high + 1) >> 1
                same = (self.sums[a + mid] - self.sums[a]) * inverse[a] == (self.sums[b + mid] - self.sums[b]) * inverse[b]
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b``, or, where ``or_equal``, isn't after it."""
        shared = self.common(a, b)
        inside = shared < self.limit
        at = np.minimum(shared, self.limit - 1)
        return np.where(inside, self.data[a + at] < self.data[b + at], or_equal)


def merge_sort(suffixes: Suffixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions of ``at`` in sorted order within each group; ``group`` is ascending, equal suffixes keep their order."""
    order = np.arange(len(at))
    begin = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - begin
    width = 1
    while len(at) and width < size.max():
        active = np.flatnonzero(size > width)
        place = active - begin[active]
        block = place // width
        left = block % 2 == 0
        other = begin[active] + (block ^ 1) * width
        end = np.minimum(other + width, begin[active] + size[active])
        low, high = np.minimum(other, end), end.copy()
        own = at[order[active]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            # An element of the left block goes before its equals of the right one.
            there = suffixes.before(at[order[mid]], own[open_], ~left[open_])
            low[open_] = np.where(there, mid + 1, low[open_])
            high[open_] = np.where(there, high[open_], mid)
        new = begin[active] + (block & ~1) * width + place % width + (low - np.minimum(other, end))
        merged = order.copy()
        merged[new] = order[active]
        order = merged
        width *= 2
    return order


def classes(data: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order (see merge_sort) and, along it, a class number that equal suffixes of a group share; verified."""
    for seed in range(101, 133):
        suffixes = Suffixes(data, limit, seed)
        order = merge_sort(suffixes, at, group)
        equal = np.zeros(len(at), bool)
        if _verified(data, at[order], group[order], limit, equal):
            return order, np.cumsum(~equal)
    raise RuntimeError("no hash sorts these suffixes")


def _verified(data: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int, equal: np.ndarray) -> bool:
    reach = np.arange(limit)
    for low in range(1, len(at), _SLICE):
        k = np.arange(low, min(len(at), low + _SLICE))
        k = k[group[k] == group[k - 1]]
        first, second = data[at[k - 1][:, None] + reach], data[at[k][:, None] + reach]
        differs = first != second
        where = differs.argmax(axis=1)
        equal[k] = ~differs.any(axis=1)
        rows = np.arange(len(k))
        if (~equal[k] & (first[rows, where] > second[rows, where])).any():
            return False
    return True
