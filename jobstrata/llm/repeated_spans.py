"""Exact removal of long repeated passages from descriptions: every byte covered by a ``LENGTH``-byte string that also
starts earlier (in a posting with a smaller id, or further up in the same one).

Suffixes are sorted in buckets that fit a task. The bucket of a string is its minimiser, the GRAM-byte gram with the
least hash, so equal strings meet and neighbouring strings mostly stay together as one run. Runs equal as a whole are
settled by two independently seeded 64-bit hashes, the earliest one stands for them; only the runs that share a minimiser but differ are read
again and their strings sorted by ``suffix_sort``, with the bytes verified. Equal runs of a batch are reduced before the
shuffle, and a minimiser with more than HOT different runs is dealt out string by string, where a batch likewise sends each
different string once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import bound_batches, written
from jobstrata.llm.polyhash import PolyHash, mix
from jobstrata.llm.suffix_sort import classes

LENGTH, GRAM = 100, 33
HOT = 2000
_SPAN = LENGTH - GRAM + 1
_CHUNK = 1 << 20  # positions within a chunk must fit 20 bits
_PLACE = np.uint64(_CHUNK - 1)
_HASH, _CHECK = PolyHash(21), PolyHash(22)
_STEPS, _OPEN_STEPS = 8, 2  # buckets of runs, and of open runs, per shuffle partition
_BATCH = 8 << 20  # bytes of text whose equal runs are reduced together
_STRINGS = 200_000  # strings sorted together, or more if one minimiser has more


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one minimiser occurrence, in texts that end at ``ends``: minimiser hash, two run hashes, start, strings."""
    empty, none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return none, none, none, empty, empty
    sums = _HASH.prefix(data)
    first = np.arange(len(data) - GRAM + 1)
    grams = mix(_HASH.stretch(sums, first, first + GRAM))
    least = (_least((grams & ~_PLACE) | first.astype(np.uint64), _SPAN) & _PLACE).astype(np.int64)
    text_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:len(least)]
    valid = np.arange(len(least)) + LENGTH <= text_end
    begins = valid.copy()
    begins[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (text_end[1:] == text_end[:-1]))
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | begins[1:]
    start = np.flatnonzero(begins)
    strings = np.flatnonzero(stops) - start + 1
    anchor = least[start]
    with np.errstate(over="ignore"):
        shape = ((anchor - start).astype(np.uint64) << np.uint64(20)) | strings.astype(np.uint64)
        whole, check = (mix(h.stretch(through, start, start + strings + LENGTH - 1) + mix(shape)) for h, through in ((_HASH, sums), (_CHECK, _CHECK.prefix(data))))
    return grams[anchor], whole, check, start, strings


def _order(ids: pa.Array, twins: np.ndarray) -> np.ndarray:
    """Numbers in the order of (id, twin), equal for equal pairs."""
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.lexsort((twins, rank))
    new = np.concatenate([[True], (rank[by][1:] != rank[by][:-1]) | (twins[by][1:] != twins[by][:-1])]) if len(by) else np.empty(0, bool)
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _changes(by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Along an order, where any of the keys differs from the one before."""
    return np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)]) if len(by) else np.empty(0, bool)


def _later(m: np.ndarray, r: np.ndarray, q: np.ndarray, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by (m, r, q, posting, start), and along it, whether an equal run stands elsewhere before."""
    by = np.lexsort((start, order, q, r, m))
    new = _changes(by, m, r, q)
    head = by[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else by
    return by, (order[by] != order[head]) | (start[by] != start[head])


def _lists(columns: list[pa.Array], cuts: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(cuts.astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, c) for c in columns]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about _BATCH bytes of text."""
    sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset:][:batch.num_rows + 1])
    part = np.cumsum(sizes.astype(np.int64)) // _BATCH
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def find_runs(jobs: DataFrame, buckets: int) -> DataFrame:
    """The runs of all texts, a row per batch and bucket. Runs that repeat within a batch keep their first occurrence;
    the others, known to be repeats, pass through with no hashes (``settled``)."""
    kind = jobs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            found: list[list[np.ndarray]] = [[], [], [], [], [], []]

            def add(row: np.ndarray, shift: int, parts: tuple[np.ndarray, ...], begins: np.ndarray) -> None:
                m, r, q, start, strings = parts
                which = np.searchsorted(begins, start, side="right") - 1
                for into, values in zip(found, (m, r, q, row[which], start - begins[which] + shift, strings)):
                    into.append(values)

            rows, group, size = [], [], 0
            texts = batch.column("text")
            for k in range(batch.num_rows + 1):
                raw = texts[k].as_buffer() if k < batch.num_rows else None
                n = raw.size if raw is not None else 0
                if group and (k == batch.num_rows or size + n > _CHUNK):
                    ends = np.cumsum([len(g) for g in group])
                    add(np.array(rows), 0, runs(np.concatenate(group), ends), np.concatenate([[0], ends[:-1]]))
                    rows, group, size = [], [], 0
                if raw is None or n < LENGTH:
                    continue
                data = np.frombuffer(raw, np.uint8)
                if n > _CHUNK:  # in overlapping pieces: every string lies in exactly one
                    for at in range(0, n - LENGTH + 1, _CHUNK - LENGTH + 1):
                        part = data[at:at + _CHUNK]
                        add(np.array([k]), at, runs(part, np.array([len(part)])), np.array([0]))
                    continue
                rows.append(k)
                group.append(data)
                size += n
            if not found[0]:
                continue
            m, r, q, row, start, strings = (np.concatenate(f) for f in found)
            twins = batch.column("twin").to_numpy()
            by, later = _later(m, r, q, _order(batch.column("id"), twins)[row], start)
            settled = np.zeros(len(m), bool)
            settled[by] = later
            bucket = np.where(settled, mix(row.astype(np.uint64)), m) % np.uint64(buckets)
            by = np.lexsort((settled, bucket))
            bucket, settled = bucket[by].astype(np.int64), settled[by]
            cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (settled[1:] != settled[:-1]), [True]]))
            for a in range(0, len(cuts) - 1, 256):
                part = cuts[a:a + 257]
                own = by[part[0]:part[-1]]
                values = [
                    *[pa.array(h[own].view(np.int64)) for h in (m, r, q)], batch.column("id").take(pa.array(row[own])), pa.array(twins[row[own]]),
                    pa.array(start[own], pa.int64()), pa.array(strings[own].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]]), pa.array(settled[part[:-1]]), *_lists(values, part - part[0])], ["bucket", "settled", "m", "r", "q", "id", "twin", "start", "strings"])

    return jobs.mapInArrow(run, f"bucket long, settled boolean, m array<long>, r array<long>, q array<long>, id array<{kind}>, twin array<long>, start array<long>, strings array<int>")


def settle(found: DataFrame, kind: str, hot_runs: int = HOT) -> DataFrame:
    """id, twin, start, strings of runs that repeat an earlier one as a whole (``anchor`` null), and of the earliest of
    each kind of run where different runs share a minimiser (``anchor``), which need sorting."""

    def run(table: pa.Table) -> pa.Table:
        def flat(rows: pa.Table) -> list[pa.Array]:
            return [rows.column(c).combine_chunks().flatten() for c in ("m", "r", "q", "id", "twin", "start", "strings")]

        settled = table.column("settled").combine_chunks()
        m, r, q, ids, twins, start, strings = flat(table.filter(pc.invert(settled)))
        key, whole, check = (h.to_numpy(zero_copy_only=False) for h in (m, r, q))
        by, later = _later(key, whole, check, _order(ids, twins.to_numpy(zero_copy_only=False)), start.to_numpy(zero_copy_only=False))
        first = by[~later]
        # Of the first ones, one per run: equal rows of one posting may repeat.
        first = first[_changes(first, key, whole, check)]
        begin = np.searchsorted(key[first], key[first], side="left")
        rivals = np.searchsorted(key[first], key[first], side="right") - begin
        open_ = first[rivals > 1]
        pick = pa.array(np.concatenate([by[later], open_]))
        n_later = int(later.sum())
        anchors = pa.concat_arrays([pa.nulls(n_later, pa.int64()), m.take(pa.array(open_))])
        hot = np.concatenate([np.zeros(n_later, bool), rivals[rivals > 1] > hot_runs])
        _, _, _, ids2, twins2, start2, strings2 = flat(table.filter(settled))
        n2 = len(ids2)
        return pa.table({
            "id": pa.concat_arrays([ids.take(pick), ids2]), "twin": pa.concat_arrays([twins.take(pick), twins2]), "start": pa.concat_arrays([start.take(pick), start2]),
            "strings": pa.concat_arrays([strings.take(pick), strings2]), "anchor": pa.concat_arrays([anchors, pa.nulls(n2, pa.int64())]), "hot": pa.concat_arrays([pa.array(hot), pa.array(np.zeros(n2, bool))]),
        })

    return found.groupBy("bucket").applyInArrow(run, f"id {kind}, twin long, start long, strings int, anchor long, hot boolean")


def cut_open_runs(texts: DataFrame, kind: str, buckets: int) -> DataFrame:
    """The bytes of the runs that need sorting, a row per batch and bucket. ``texts`` has the runs of each text as ``open``.
    Single strings of hot minimisers have their content hash as ``anchor``; of equal ones in a batch the earliest is sent, and
    the others, known to be repeats, pass through with no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, rows, starts, counts, hot, pieces = [], [], [], [], [], []
            for k in range(batch.num_rows):
                if not batch.column("open")[k].is_valid:
                    continue
                data = batch.column("text")[k].as_buffer().to_pybytes()
                for one in batch.column("open")[k].as_py():
                    a, n = one["start"], one["strings"]
                    for at, many in [(a + j, 1) for j in range(n)] if one["hot"] else [(a, n)]:
                        anchors.append(one["anchor"])
                        rows.append(k)
                        starts.append(at)
                        counts.append(many)
                        hot.append(one["hot"])
                        pieces.append(data[at:at + many + LENGTH - 1])
            if not rows:
                continue
            data = np.frombuffer(b"".join(pieces), np.uint8)
            counts_, row = np.array(counts), np.array(rows)
            end = np.cumsum(counts_ + LENGTH - 1)
            begin = end - counts_ - LENGTH + 1
            anchor = np.array(anchors, np.int64)
            content = mix(_HASH.stretch(_HASH.prefix(data), begin, begin + LENGTH))
            # The single strings of hot minimisers are spread by content.
            single, start, twins = np.flatnonzero(hot), np.array(starts), batch.column("twin").to_numpy()
            anchor = np.where(np.array(hot), content, anchor.view(np.uint64))
            stay = np.ones(len(row), bool)
            again = np.empty(0, np.int64)
            if len(single):
                order = _order(batch.column("id"), twins)[row]
                by = single[np.lexsort((start[single], order[single], content[single]))]
                new = np.concatenate([[True], content[by][1:] != content[by][:-1]])
                head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
                same = np.array([pieces[k] == pieces[h] for k, h in zip(by.tolist(), head.tolist())]) & (by != head)
                stay[by[same]] = False
                later = same & ((order[by] != order[head]) | (start[by] != start[head]))
                again = by[later][np.lexsort((start[by[later]], row[by[later]]))]
            bucket = anchor % np.uint64(buckets)
            by = np.flatnonzero(stay)
            by = by[np.argsort(bucket[by], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1], [True]]))

            def rows_of(bucket: np.ndarray, own: np.ndarray, many: np.ndarray, cuts: np.ndarray, joined: pa.Array) -> pa.RecordBatch:
                values = [pa.array(anchor[own].view(np.int64)), batch.column("id").take(pa.array(row[own])), pa.array(twins[row[own]]), pa.array(start[own]), pa.array(many.astype(np.int32))]
                return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), *_lists(values, cuts), joined], ["bucket", "anchor", "id", "twin", "start", "strings", "data"])

            yield rows_of(bucket[by][cuts[:-1]], by, counts_[by], cuts, pa.array([b"".join(pieces[p] for p in by[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()))
            if len(again):
                joins = np.concatenate([[True], (row[again][1:] != row[again][:-1]) | (start[again][1:] != start[again][:-1] + 1)])
                heads = np.flatnonzero(joins)
                own, many = again[heads], np.diff(np.append(heads, len(again)))
                cuts = np.flatnonzero(np.concatenate([[True], row[own][1:] != row[own][:-1], [True]]))
                yield rows_of(mix(row[own][cuts[:-1]].astype(np.uint64)) % np.uint64(buckets), own, many, cuts, pa.nulls(len(cuts) - 1, pa.binary()))

    return texts.mapInArrow(run, f"bucket long, anchor array<long>, id array<{kind}>, twin array<long>, start array<long>, strings array<int>, data binary")


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def _pieces(data: np.ndarray, anchor: np.ndarray, order: np.ndarray, start: np.ndarray, count: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings that also start earlier: owner, start and number, sorting whole minimisers at a time."""
    by_anchor = np.argsort(anchor, kind="stable")
    part = np.cumsum(count[by_anchor]) // _STRINGS
    first = np.concatenate([[True], anchor[by_anchor][1:] != anchor[by_anchor][:-1]]) if len(part) else np.empty(0, bool)
    part = part[np.flatnonzero(first)][np.cumsum(first) - 1] if len(part) else part  # a minimiser goes with its first run
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.empty(0, int)
    for low, high in zip(cuts[:-1], cuts[1:]):
        rows = by_anchor[low:high]
        # The bytes of these runs only, one after another.
        size = count[rows] + LENGTH - 1
        base = np.cumsum(size) - size
        own = data[np.repeat(begin[rows] - base, size) + np.arange(size.sum())]
        index = np.repeat(np.arange(len(rows)), count[rows])
        step = np.arange(len(index)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        at, owner = base[index] + step, rows[index]
        place = start[owner] + step
        # Equal strings agree in the minimiser and in their first and last bytes: only those need comparing.
        keys = [_eight(own, at + LENGTH - 8), _eight(own, at), anchor[owner]]
        by = np.lexsort((place, order[owner], *keys))
        new = np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)])
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        by, group = by[several], group[several]
        if not len(by):
            continue
        sorted_, number = classes(own, at[by], group, LENGTH)
        by = by[sorted_]
        # Within a class the merge sort kept (posting, start): the first entry is the earliest.
        head = np.concatenate([[True], number[1:] != number[:-1]])
        earliest = by[np.flatnonzero(head)][np.cumsum(head) - 1]
        again = by[(order[owner[by]] != order[owner[earliest]]) | (place[by] != place[earliest])]
        if not len(again):
            continue
        again = again[np.lexsort((place[again], owner[again]))]
        joins = np.concatenate([[True], (owner[again][1:] != owner[again][:-1]) | (place[again][1:] != place[again][:-1] + 1)])
        heads = np.flatnonzero(joins)
        yield owner[again[heads]], place[again[heads]], np.diff(np.append(heads, len(again)))


def sort_open_runs(opened: DataFrame, kind: str) -> DataFrame:
    """id, twin, start, strings of the strings that also start earlier: known repeats, and by sorting all strings of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.column("data").is_null()
        _, *known = (table.filter(settled).column(c).combine_chunks().flatten() for c in ("anchor", "id", "twin", "start", "strings"))
        table = table.filter(pc.invert(settled))
        anchor, ids, twins, start, strings = (table.column(c).combine_chunks().flatten() for c in ("anchor", "id", "twin", "start", "strings"))
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        count = strings.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
        order = _order(ids, twins.to_numpy(zero_copy_only=False))
        owners, places, lengths = [], [], []
        for owner, place, length in _pieces(data, anchor.to_numpy(zero_copy_only=False), order, start.to_numpy(zero_copy_only=False), count, begin):
            owners.append(owner)
            places.append(place)
            lengths.append(length)
        none = np.empty(0, np.int64)
        pick = pa.array(np.concatenate([none, *owners]))
        found = [ids.take(pick), twins.take(pick), pa.array(np.concatenate([none, *places])), pa.array(np.concatenate([none, *lengths]).astype(np.int32))]
        return pa.table({name: pa.concat_arrays([*both]) for name, *both in zip(("id", "twin", "start", "strings"), found, known)})

    return opened.groupBy("bucket").applyInArrow(run, f"id {kind}, twin long, start long, strings int")


def remove_repeats(jobs: DataFrame, hot_runs: int = HOT) -> DataFrame:
    """id, n_bytes, spans (removed, as byte offsets from start to end), kept (the remaining bytes) of every posting.

    Input: id of any orderable type, description_raw; other columns are ignored. Null texts are empty. Strings never cross
    postings and are judged on the input. Rows equal in id and text count as one posting, each is returned; rows with one
    id and different texts are ordered by a hash of the text. An empty table gives no rows.
    """
    kind = jobs.schema["id"].dataType.simpleString()
    texts = bound_batches(jobs).select("id", F.xxhash64("description_raw").alias("twin"), F.coalesce("description_raw", F.lit("")).cast("binary").alias("text"))
    buckets = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(settle(find_runs(texts, _STEPS * buckets), kind, hot_runs), "runs")
    keys = ["id", "twin"]
    marks = found.filter("anchor is not null").groupBy(*keys).agg(F.collect_set(F.struct("start", "strings", "anchor", "hot")).alias("open"))
    # Both joins shuffle the texts alike, so that one shuffle serves them; left joins keep rows without marks.
    opened = _joined(texts, marks, "open")
    sorted_ = sort_open_runs(cut_open_runs(opened, kind, _OPEN_STEPS * buckets), kind)
    repeats = found.filter("anchor is null").select(*keys, "start", "strings").union(sorted_)
    spans = repeats.groupBy(*keys).agg(F.collect_list(F.struct("start", "strings")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sizes, found_spans, kept = [], [], []
                for k in range(part.num_rows):
                    data = part.column("text")[k].as_buffer().to_pybytes()
                    marks_ = part.column("marks")[k]
                    cut = _merged(marks_.values) if marks_.is_valid else np.empty((0, 2), np.int64)
                    sizes.append(len(data))
                    found_spans.append([{"start": s, "end": e} for s, e in cut.tolist()])
                    edges = [0, *cut.ravel().tolist(), len(data)]
                    kept.append(b"".join(data[edges[j]:edges[j + 1]] for j in range(0, len(edges), 2)))
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(found_spans, spans_type), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return _joined(texts, spans, "marks").mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _joined(texts: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    right = marks.withColumnsRenamed({"id": "_id", "twin": "_twin"})
    return texts.join(right, texts["id"].eqNullSafe(right["_id"]) & (texts["twin"] == right["_twin"]), "left").select("id", "twin", "text", name)


def _merged(marks: pa.StructArray) -> np.ndarray:
    """Start and end of the maximal stretches that the marked strings cover."""
    start = marks.field("start").to_numpy(zero_copy_only=False)
    end = start + marks.field("strings").to_numpy(zero_copy_only=False) + LENGTH - 1
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[heads], end[np.append(heads[1:] - 1, len(start) - 1)]], axis=1)
