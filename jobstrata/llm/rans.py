"""Static range asymmetric numeral system over token ids: one file image is one frequency table and independent blocks.

Layout of an image, all little-endian: header, table (symbols and their frequencies, which sum to 2^bits), token counts
of the postings, block directory, blocks. A block deals its tokens over interleaved lanes: token k belongs to lane
k % lanes, step k // lanes. It holds 32-bit words in the order a decoder takes them, and checkpoints (step, words taken,
state of every lane), so that decoding can start at any checkpoint of any block. A block ends with every lane in the
start state, and its tokens have a CRC-32; both are checked.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
MAGIC, VERSION, BITS, LOW = b"JSTK", 1, 20, 1 << 31
HEADER = struct.Struct("<4sHHIQQI")  # magic, version, bits, symbols, postings, tokens, blocks
ENTRY = struct.Struct("<QIIIII")  # tokens, lanes, steps between checkpoints, checkpoints, words, crc of the tokens
BLOCK_TOKENS, MAX_LANES, STEPS = 1 << 19, 2048, 128


def table_of(tokens: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted symbols and frequencies of at least 1 that sum to 2^bits."""
    counted = np.bincount(tokens)
    symbols = np.flatnonzero(counted)
    counts = counted[symbols]
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint64)
    if len(symbols) > 1 << bits:
        raise ValueError("more symbols than slots")
    free = (1 << bits) - len(symbols)
    share = counts.astype(np.float64) * free / counts.sum()
    freqs = 1 + np.floor(share).astype(np.int64)
    rest = (1 << bits) - int(freqs.sum())
    freqs[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
    return symbols.astype(np.uint32), freqs.astype(np.uint64)


def _encode_block(index: np.ndarray, freqs: np.ndarray, starts: np.ndarray, bits: int) -> tuple[int, bytes, int, int]:
    n = len(index)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    saved = {}
    shift, word = np.uint64(bits), np.uint64(32)
    own_freq, own_start = freqs[index], starts[index]
    most = own_freq << np.uint64(63 - bits)
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(n, (step + 1) * lanes))
        f = own_freq[part]
        own = x[:len(f)]
        over = np.flatnonzero(own >= most[part])
        full = own[over]
        words[step] = full.astype(np.uint32)
        own[over] = full >> word
        q = own // f
        x[:len(f)] = (q << shift) + (own - q * f) + own_start[part]
        if step % STEPS == 0:
            saved[step] = x.copy()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    points = b"".join(struct.pack("<IQ", s, before[s]) + saved[s].astype("<u8").tobytes() for s in sorted(saved))
    return lanes, points + np.concatenate(words).astype("<u4").tobytes(), len(saved), int(before[-1])


def encode(tokens: np.ndarray, counts: list[int], bits: int = BITS, block_tokens: int = BLOCK_TOKENS) -> bytes:
    """The image of some postings' tokens, one after another; ``counts`` are their numbers of tokens."""
    symbols, freqs = table_of(tokens, bits)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    entries, bodies = [], []
    for at in range(0, len(tokens), block_tokens):
        part = tokens[at:at + block_tokens]
        lanes, body, points, n_words = _encode_block(place[part], freqs, starts, bits)
        entries.append(ENTRY.pack(len(part), lanes, STEPS, points, n_words, zlib.crc32(part.astype("<u4").tobytes())))
        bodies.append(body)
    head = HEADER.pack(MAGIC, VERSION, bits, len(symbols), len(counts), len(tokens), len(bodies))
    table = symbols.astype("<u4").tobytes() + freqs.astype("<u4").tobytes()
    return b"".join([head, table, np.asarray(counts, "<u8").tobytes(), *entries, *bodies])


class Image:
    """A file image opened for reading; ``block`` decodes one block, alone or from one of its checkpoints on."""

    def __init__(self, data: bytes):
        magic, version, self.bits, n_symbols, n_counts, self.n_tokens, n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEADER.size
        self.symbols = np.frombuffer(data, "<u4", n_symbols, at)
        self.freqs = np.frombuffer(data, "<u4", n_symbols, at + 4 * n_symbols).astype(np.uint64)
        at += 8 * n_symbols
        self.counts = np.frombuffer(data, "<u8", n_counts, at).astype(np.int64)
        at += 8 * n_counts
        self.starts = (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), self.freqs.astype(np.int64))
        self.entries = [ENTRY.unpack_from(data, at + k * ENTRY.size) for k in range(n_blocks)]
        at += n_blocks * ENTRY.size
        self.data, self.at = data, []
        for _, lanes, _, points, n_words, _ in self.entries:
            self.at.append(at)
            at += points * (12 + 8 * lanes) + 4 * n_words
        if at != len(data):
            raise ValueError("token file cut short")

    def block(self, k: int, point: int = 0) -> np.ndarray:
        """Tokens of block ``k`` from checkpoint ``point`` on; the whole block is checked against its checksum."""
        n, lanes, every, points, n_words, crc = self.entries[k]
        size = 12 + 8 * lanes
        step, taken = struct.unpack_from("<IQ", self.data, self.at[k] + point * size)
        x = np.frombuffer(self.data, "<u8", lanes, self.at[k] + point * size + 12).astype(np.uint64)
        words = np.frombuffer(self.data, "<u4", n_words, self.at[k] + points * size).astype(np.uint64)
        out = np.empty(n - step * lanes, np.uint32)
        shift, mask, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(LOW)
        for done in range(0, len(out), lanes):
            own = x[:min(lanes, len(out) - done)]
            slot = own & mask
            index = self.slots[slot]
            out[done:done + len(own)] = index
            own = self.freqs[index] * (own >> shift) + slot - self.starts[index]
            need = np.flatnonzero(own < low)
            own[need] = (own[need] << np.uint64(32)) | words[taken:taken + len(need)]
            taken += len(need)
            x[:len(own)] = own
        tokens = self.symbols[out]
        if taken != n_words or (x != low).any() or (point == 0 and zlib.crc32(tokens.astype("<u4").tobytes()) != crc):
            raise ValueError(f"block {k} fails its checksum")
        return tokens

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.entries))] or [np.empty(0, np.uint32)])
