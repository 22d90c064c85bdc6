"""Word shingles of descriptions as sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from jobstrata.llm.polyhash import PolyHash, mix

WIDTH = 5
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASH = PolyHash(3)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they start."""
    space = _SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = _HASH.prefix(_LOWER[data])
    with np.errstate(over="ignore"):
        return mix(_HASH.stretch(sums, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of one text, piece by piece, cut at white space: memory follows the words, not the bytes."""
    data, found, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end:end + _CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + _CHUNK)
        found.append(_word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(found or [np.empty(0, np.uint64)])


def _sets(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            grams = grams * np.uint64(0xA0761D6478BD642F) + words[k:k + len(grams)]
    grams = mix(grams)
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(grams[at:at + n - width + 1])
        elif n:
            with np.errstate(over="ignore"):
                whole = np.uint64(n)
                for w in words[at:at + n]:
                    whole = whole * np.uint64(0xE7037ED1A0B428DB) + w
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += n


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``width``-word shingles.

    Words are runs without white space, A-Z lower-cased. A text of fewer words has one shingle, all of them; null and
    empty texts have none.
    """
    group, size = [], 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            data = np.frombuffer(b"\n".join(group), np.uint8)
            words, starts = _word_hashes(data)
            begins = np.cumsum([0] + [len(raw) + 1 for raw in group[:-1]])
            counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
            yield from _sets(words, counts, width)

    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if group and size + len(raw) > _CHUNK:
            yield from flush()
            group, size = [], 0
        if len(raw) > _CHUNK:
            words = _long(raw)
            yield from _sets(words, np.array([len(words)]), width)
        else:
            group.append(raw)
            size += len(raw) + 1
    yield from flush()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
