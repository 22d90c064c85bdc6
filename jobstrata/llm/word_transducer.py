"""A finite-state transducer over UTF-8 bytes, as tables, and a hash table of the words it finds.

The machine has three states: outside a word, inside one at the end of a character, inside one within a character. Its next
state follows from the byte alone, so the states of a whole array of bytes are one table lookup, and what the machine
puts out at a byte is a second lookup by (state before, byte): a word begins, a word ended, a code point, a capital, a
symbol. One such pass over many joined texts gives all counts and all word spans.

Spans go into an open-addressing table keyed by text and word, all at once: each round every open span looks at its slot,
takes a free one, is settled by an equal word (compared byte by byte, not by hash) or moves on to the next slot.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from jobstrata.llm.polyhash import mix

#: Fixed values of the audit.
SPACES = (*range(9, 14), 32)
SYMBOLS = b"#$%&*|"

OUTSIDE, INSIDE, WITHIN = 0, 1, 2
BEGINS, ENDED = 1, 2
_PIECE = 1 << 20  # bytes of a pass
_POINT, _CAPITAL, _SYMBOL = 1, 1 << 21, 1 << 42  # three counters of 21 bits in one long


def _state_after() -> np.ndarray:
    table = np.full(256, INSIDE, np.uint8)
    table[list(SPACES)] = OUTSIDE
    table[0x80:] = WITHIN  # whether a multi-byte character is over only shows at the next byte
    return table


def _outputs() -> tuple[np.ndarray, np.ndarray]:
    """Events and counter steps by state before * 256 + byte."""
    events, steps = np.zeros((3, 256), np.uint8), np.zeros((3, 256), np.int64)
    space = np.isin(np.arange(256), SPACES)
    events[OUTSIDE, ~space] = BEGINS
    events[INSIDE, space] = events[WITHIN, space] = ENDED
    points = (np.arange(256) & 0xC0) != 0x80
    steps[:, points] += _POINT
    steps[:, 65:91] += _CAPITAL
    steps[:, list(SYMBOLS)] += _SYMBOL
    return events.ravel(), steps.ravel()


STATE_AFTER = _state_after()
EVENTS, STEPS = _outputs()


class Counts(NamedTuple):
    """One value per text."""

    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray


def transduce(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counter sums per text, and starts and ends of all words. Each text ends with a white-space byte of its own."""
    before = np.empty(len(data), np.uint16)
    before[0] = OUTSIDE
    before[1:] = STATE_AFTER[data[:-1]]
    at = before * np.uint16(256) + data
    events = EVENTS[at]
    sums = np.add.reduceat(STEPS[at], begins)
    return sums, np.flatnonzero(events == BEGINS), np.flatnonzero(events == ENDED)


def _octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number. ``data`` has eight spare bytes at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(octets: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = mix((octets[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        rest, at = np.flatnonzero(lengths > 8), 8
        while len(rest):
            left = np.minimum(lengths[rest] - at, 8)
            found[rest] = mix(found[rest] * np.uint64(0xA0761D6478BD642F) + (octets[starts[rest] + at] & _MASK[left]))
            at += 8
            rest = rest[lengths[rest] > at]
        return mix(found + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _equal(octets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[k] and b[k] hold the same bytes."""
    same = lengths[a] == lengths[b]
    same &= ((octets[starts[a]] ^ octets[starts[b]]) & _MASK[np.minimum(lengths[a], 8)]) == 0
    rest, at = np.flatnonzero(same & (lengths[a] > 8)), 8
    while len(rest):
        x, y = a[rest], b[rest]
        left = np.minimum(lengths[x] - at, 8)
        same[rest] = ((octets[starts[x] + at] ^ octets[starts[y] + at]) & _MASK[left]) == 0
        at += 8
        rest = rest[same[rest] & (lengths[x] > at)]
    return same


def first_words(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """The numbers of the words that stand for all equal ones of their text. ``hashes``: for tests."""
    lengths, octets = ends - starts, _octets(data)
    found = _hashes(octets, text, starts, lengths) if hashes is None else hashes
    bits = max(4, int(2 * len(starts)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    slot = (found >> np.uint64(64 - bits)).astype(np.int64)
    open_ = np.arange(len(starts), dtype=np.int32)
    winners = []
    while len(open_):
        free = table[slot] < 0
        table[slot[free]] = open_[free]  # of several that want one slot, one gets it; the others meet it right now
        holder = table[slot]
        won = holder == open_
        winners.append(open_[won])
        going = ~won
        open_, slot, holder = open_[going], slot[going], holder[going]
        other = ~((text[open_] == text[holder]) & _equal(octets, starts, lengths, open_, holder))
        open_, slot = open_[other], (slot[other] + 1) & ((1 << bits) - 1)
    return np.concatenate(winners) if winners else np.empty(0, np.int32)


def _pass(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counter sums, words per text, and text, start and end of every word with its padded bytes."""
    data = np.frombuffer(b"\n".join(raws) + b"\n" + bytes(8), np.uint8)
    begins = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
    sums, starts, ends = transduce(data[:-8], begins)
    return sums - _POINT, np.searchsorted(begins, starts, "right") - 1, starts, ends, data


def _split(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << 21) - 1
    return sums & low, sums >> 21 & low, sums >> 42 & low


def _cut(data: np.ndarray, at: int) -> int:
    """Where the piece from ``at`` on ends: after the last white space within a pass, else where its one long word ends."""
    end = min(len(data), at + _PIECE)
    if end < len(data) and len(gaps := np.flatnonzero(STATE_AFTER[data[at:end]] == OUTSIDE)):
        return at + int(gaps[-1]) + 1
    while end < len(data):
        if len(gaps := np.flatnonzero(STATE_AFTER[data[end:end + _PIECE]] == OUTSIDE)):
            return end + int(gaps[0])
        end = min(len(data), end + _PIECE)
    return end


def _long(raw: bytes) -> tuple[int, int, int, int, int]:
    """The counts of a text longer than a pass, piece by piece. Different words of the pieces meet in a set."""
    data, counts, words, seen, at = np.frombuffer(raw, np.uint8), np.zeros(3, np.int64), 0, set(), 0
    while at < len(raw):
        end = _cut(data, at)
        if end - at > _PIECE:  # one word
            sums = np.array([STEPS[data[k:min(end, k + _PIECE)]].sum() for k in range(at, end, _PIECE)])
            words += 1
            seen.add(raw[at:end])
        else:
            piece = raw[at:end]
            sums, text, starts, ends, padded = _pass([piece])
            words += len(starts)
            seen.update(piece[starts[k]:ends[k]] for k in first_words(padded, text, starts, ends).tolist())
        counts += np.array([s.sum() for s in _split(sums)])
        at = end
    points, capitals, symbols = counts.tolist()
    return words, len(seen), capitals, points, symbols


def count_texts(texts: list[str | None]) -> Counts:
    """Words, different words, capitals, code points and symbols of every text; null counts as empty."""
    found = np.zeros((len(texts), 5), np.int64)
    group: list[bytes] = []
    places: list[int] = []
    size = 0

    def flush() -> None:
        sums, text, starts, ends, data = _pass(group)
        points, capitals, symbols = _split(sums)
        first = first_words(data, text, starts, ends)
        n = len(group)
        found[places] = np.stack([np.bincount(text, minlength=n), np.bincount(text[first], minlength=n), capitals, points, symbols], axis=1)

    for k, value in enumerate(texts):
        raw = (value or "").encode("utf-8", "replace")
        if group and size + len(raw) >= _PIECE:
            flush()
            group, places, size = [], [], 0
        if len(raw) >= _PIECE:
            found[k] = _long(raw)
        else:
            group.append(raw)
            places.append(k)
            size += len(raw) + 1
    if group:
        flush()
    return Counts(*found.T)
