"""How two tokenizers cut the same description texts: aligned groups of tokens, and which tokens go together how often.

Vocabulary A is byte-level and sees a blank and the text; B is a sentence-piece vocabulary and adds the blank itself. Tokens
spell bytes. Where a token of each ends at the same byte there is a cut; the two tokens are linked, and the tokens since
the last cut form a group.

The merge goes in lockstep: documents are split into sections of some bytes, and one state vector holds the next A and
B token of every section of a batch. Each step compares where the two tokens of all sections end, hands on the links and
moves the pointers of the tokens that end first; finished sections leave the vector. Sections need not begin at a cut,
as a section only looks for ends that lie in it, so a long text takes no more steps than a short one.

Two linked tokens end together, so the bytes of one end those of the other. Which pairs of ids can be linked at all follows
from the vocabularies (some hundred thousand pairs); pairs are counted by their number in that list. The counts of all pairs are
therefore bounded by the vocabularies, whatever the corpus, and may be collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import bound_batches, written
from jobstrata.llm.pieces import Pieces
from jobstrata.llm.sentence_pieces import SentencePieces

SECTION = 512  # bytes
_BATCH = 1 << 18  # bytes aligned at a time
_ROWS = 128  # packed texts read at a time
_PACKED = ("tokens_a", "tokens_b", "cuts_a", "cuts_b")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Spellings:
    """The bytes of each id, joined."""

    def __init__(self, spelled: list[bytes]):
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.length[ids]
        through = np.cumsum(lengths)
        return self.data[np.repeat(self.begin[ids] - through + lengths, lengths) + np.arange(through[-1] if len(ids) else 0)]


class Pair:
    """The two vocabularies and the pairs of ids that can be linked, in ascending order (A's id first)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Pieces(path_a), SentencePieces(path_b)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        named, byte = self.a.tokenizer.get_vocab(with_added_tokens=True), byte_of_character()
        special = {t.content for t in self.a.tokenizer.get_added_tokens_decoder().values()}
        spelled = [b""] * (max(named.values()) + 1)
        for token, number in named.items():
            spelled[number] = b"" if token in special else bytes(byte[c] for c in token)
        self.spelled_a, self.spelled_b = spelled, self.b.spelled
        self.bytes_a, self.bytes_b = Spellings(self.spelled_a), Spellings(self.spelled_b)
        self.pairs = self._pairs()
        width = len(str(max(len(self.spelled_a), len(self.spelled_b))))
        digits = np.arange(max(len(self.spelled_a), len(self.spelled_b)))[:, None] // 10 ** np.arange(width - 1, -1, -1)
        #: Decimal digits of each id, zero bytes before them, and a place for the sign that follows.
        self.decimal = np.concatenate([np.where((digits > 0) | (np.arange(width) == width - 1), 48 + digits % 10, 0), np.zeros((len(digits), 1), int)], axis=1).astype(np.uint8)

    def _pairs(self) -> np.ndarray:
        found = set()
        by_bytes: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for known, spelled in zip(by_bytes, (self.spelled_a, self.spelled_b)):
            for number, s in enumerate(spelled):
                known.setdefault(s, []).append(number)
        for number, s in enumerate(self.spelled_a):
            found.update(number << 32 | other for k in range(len(s)) for other in by_bytes[1].get(s[k:], ()))
        for number, s in enumerate(self.spelled_b):
            found.update(other << 32 | number for k in range(len(s)) for other in by_bytes[0].get(s[k:], ()))
        return np.array(sorted(found), np.int64)

    def numbers(self, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        """The places of linked ids in ``pairs``."""
        return np.searchsorted(self.pairs, ids_a.astype(np.int64) << 32 | ids_b.astype(np.int64))


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that end together, ascending. ``ends``: where tokens end, ascending; ``bounds``: where
    sections begin and, last, where everything ends."""
    from_a, from_b = np.searchsorted(ends_a, bounds, "right"), np.searchsorted(ends_b, bounds, "right")
    a, stop_a, b, stop_b = from_a[:-1].copy(), from_a[1:], from_b[:-1].copy(), from_b[1:]
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    going = (a < stop_a) & (b < stop_b)
    while True:
        if not going.all():
            a, stop_a, b, stop_b = a[going], stop_a[going], b[going], stop_b[going]
        if not len(a):
            return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))
        end_a, end_b = ends_a[a], ends_b[b]
        linked = end_a == end_b
        links_a.append(a[linked])
        links_b.append(b[linked])
        a += end_a <= end_b
        b += end_b <= end_a
        going = (a < stop_a) & (b < stop_b)


class Aligned(NamedTuple):
    """The tokens of some texts and the sizes of their groups; ``counts``: how many of each list belong to a text."""

    tokens_a: np.ndarray
    tokens_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    counts: np.ndarray  # texts x 4


def _kept(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], np.where(keep, counts, 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    through = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return through[ends] - through[ends - counts]


def align(pair: Pair, texts: list[str | None], section: int = SECTION) -> Aligned:
    raws = [(" " + t).encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    (ids_a, n_a), (ids_b, n_b) = pair.a.encode([" " + t if t else "" for t in texts]), pair.b.encode([t or "" for t in texts])
    keep = (_sums(pair.bytes_a.length[ids_a], n_a) == sizes) & (_sums(pair.bytes_b.length[ids_b], n_b) == sizes)
    (ids_a, n_a), (ids_b, n_b) = _kept(ids_a, n_a, keep), _kept(ids_b, n_b, keep)
    data = np.frombuffer(b"".join(r for r, k in zip(raws, keep) if k), np.uint8)
    wrong = (pair.bytes_a.of(ids_a) != data) | (pair.bytes_b.of(ids_b) != data)
    if wrong.any():
        sizes = np.where(keep, sizes, 0)
        keep = keep & (_sums(wrong.astype(np.int64), sizes) == 0)
        (ids_a, n_a), (ids_b, n_b) = _kept(ids_a, n_a, keep), _kept(ids_b, n_b, keep)
    sizes = np.where(keep, sizes, 0)
    stops = np.cumsum(sizes)
    pieces = -(-sizes // section)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    bounds = np.append(np.repeat(stops - sizes, pieces) + inner * section, stops[-1] if len(stops) else 0)
    links_a, links_b = lockstep(np.cumsum(pair.bytes_a.length[ids_a]), np.cumsum(pair.bytes_b.length[ids_b]), bounds)
    groups = np.diff(np.searchsorted(links_a, np.concatenate([[0], np.cumsum(n_a)])))
    return Aligned(ids_a, ids_b, np.diff(links_a, prepend=-1), np.diff(links_b, prepend=-1), np.stack([n_a, n_b, groups, groups], axis=1))


def written_groups(pair: Pair, found: Aligned) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``, ids in decimal; empty without tokens."""
    last_a, last_b = np.cumsum(found.group_a) - 1, np.cumsum(found.group_b) - 1
    total = len(found.tokens_a) + len(found.tokens_b)
    ids, sign = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    # An A token stands behind the B tokens of all groups before its own, a B token behind the A tokens through its own.
    at_a = np.arange(len(found.tokens_a)) + np.repeat(last_b + 1 - found.group_b, found.group_a)
    at_b = np.arange(len(found.tokens_b)) + np.repeat(last_a + 1, found.group_b)
    ids[at_a], ids[at_b] = found.tokens_a, found.tokens_b
    sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
    table = pair.decimal[ids]
    table[:, -1] = sign
    flat = table.ravel()
    flat = flat[flat != 0].tobytes()
    ends = np.concatenate([[0], np.cumsum((table != 0).sum(axis=1))])[np.cumsum(found.counts[:, 0] + found.counts[:, 1])]
    begins = np.concatenate([[0], ends[:-1]])
    return [flat[x:max(x, y - 1)].decode() for x, y in zip(begins.tolist(), ends.tolist())]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts of ``most`` bytes or a little less; a longer one alone."""
    start = size = 0
    for k, own in enumerate(sizes):
        if k > start and size + own > most:
            yield start, k
            start, size = k, 0
        size += own
    if start < len(sizes):
        yield start, len(sizes)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary per text out of the values of all."""
    raw = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], np.cumsum(counts)]) * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _bits(sizes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Per text a bit for each token, 1 for the last one of a group."""
    last = np.zeros(int(counts.sum()), np.uint8)
    last[np.cumsum(sizes) - 1] = 1
    octets = -(-counts // 8)
    # Every text begins on a byte of its own.
    place = np.arange(len(last)) + np.repeat(np.cumsum(8 * octets) - 8 * octets - np.cumsum(counts) + counts, counts)
    spread = np.zeros(8 * int(octets.sum()), np.uint8)
    spread[place] = last
    return _binary(np.packbits(spread, bitorder="little"), octets)


def _dtype(pair: Pair) -> str:
    return "<u2" if max(len(pair.spelled_a), len(pair.spelled_b)) <= 1 << 16 else "<u4"


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(pc.binary_length(column), np.int64)
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[first:first + int(sizes.sum())] if data is not None else np.empty(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), sizes // width


def _sizes(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Group sizes from the bits of :func:`_bits`."""
    octets, held = _flat(column, "u1")
    bits = np.unpackbits(octets, bitorder="little")
    place = np.arange(int(counts.sum())) + np.repeat(np.cumsum(8 * held) - 8 * held - np.cumsum(counts) + counts, counts)
    return np.diff(np.flatnonzero(bits[place]), prepend=-1)


def _read(pair: Pair, batch: pa.RecordBatch) -> Aligned:
    (ids_a, n_a), (ids_b, n_b) = (_flat(batch.column(c), _dtype(pair)) for c in _PACKED[:2])
    group_a, group_b = _sizes(batch.column("cuts_a"), n_a), _sizes(batch.column("cuts_b"), n_b)
    # The last token of a text always ends a group, so a text's groups end with its tokens.
    groups = np.diff(np.searchsorted(np.cumsum(group_a), np.concatenate([[0], np.cumsum(n_a)]), "right"))
    return Aligned(ids_a, ids_b, group_a, group_b, np.stack([n_a, n_b, groups, groups], axis=1))


def _slices(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Rows of packed tokens, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _read(pair, part)


def packed_tokens(jobs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """id, tokens_a, tokens_b, cuts_a, cuts_b of every posting: all token ids as little-endian numbers of two bytes (four for large
    vocabularies), and a bit for each token, 1 for the last one of a group."""
    paths = vocabularies or default_vocabularies()
    id_type = jobs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        for batch in batches:
            texts = batch.column("description_raw")
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for start, end in _runs(sizes.tolist(), _BATCH):
                found = align(pair, texts.slice(start, end - start).to_pylist())
                n_a, n_b = found.counts[:, 0], found.counts[:, 1]
                columns = [_binary(found.tokens_a.astype(_dtype(pair)), n_a), _binary(found.tokens_b.astype(_dtype(pair)), n_b), _bits(found.group_a, n_a), _bits(found.group_b, n_b)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), *columns], ["id", *_PACKED])

    schema = f"id {id_type}, " + ", ".join(f"{c} binary" for c in _PACKED)
    return bound_batches(jobs.select("id", "description_raw")).mapInArrow(run, schema)


def link_counts(packed: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """pair (a number in ``Pair.pairs``), n: how many links of all postings hold the pair. At most one row per possible pair."""
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        totals = np.zeros(len(pair.pairs), np.int64)
        for _, found in _slices(pair, batches):
            totals += np.bincount(_linked(pair, found), minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["pair", "n"])

    return packed.select(*_PACKED).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _linked(pair: Pair, found: Aligned) -> np.ndarray:
    """The pair numbers of all links: the last tokens of each group."""
    return pair.numbers(found.tokens_a[np.cumsum(found.group_a) - 1], found.tokens_b[np.cumsum(found.group_b) - 1])


def align_tokenizers(jobs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``) of every posting.

    A pair's count is how many links of the whole table hold it. n_best counts the links whose pair is the most frequent one of
    its B id (ties included), count_sum adds up the counts of all links. Input: id, description_raw; other columns are ignored. Texts that are
    null or empty, or that either vocabulary doesn't spell back, have no tokens: zeros and an empty string. Repeated rows count one by
    one; an id may be null. An empty table gives no rows. ``vocabularies``: files of A (tokenizers) and B (sentencepiece).
    """
    paths = vocabularies or default_vocabularies()
    id_type = jobs.schema["id"].dataType.simpleString()
    packed = written(packed_tokens(jobs, paths), "aligned", compression="zstd")
    pairs = _pair(*paths).pairs
    counts, most = np.zeros(len(pairs), np.int64), np.zeros(int((pairs & 0xFFFFFFFF).max()) + 1, np.int64)
    for row in link_counts(packed, paths).collect():  # bounded by the vocabularies
        counts[row["pair"]] = row["n"]
    np.maximum.at(most, pairs & 0xFFFFFFFF, counts)
    shared = jobs.sparkSession.sparkContext.broadcast((counts, counts == most[pairs & 0xFFFFFFFF]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (n, best) = _pair(*paths), shared.value
        for part, found in _slices(pair, batches):
            linked, groups = _linked(pair, found), found.counts[:, 2]
            columns = [found.counts[:, 0], found.counts[:, 1], groups, groups, _sums(best[linked].astype(np.int64), groups), _sums(n[linked], groups)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(written_groups(pair, found), pa.string())], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    schema = f"id {id_type}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", groups string"
    return bound_batches(packed).mapInArrow(run, schema)
