"""SimHash near duplicates of description texts, by multi-index hashing.

A fingerprint has 64 bits. Two that differ in at most ``RADIUS`` = 4 differ by at most one bit in segment 0, or by at most
one in segment 1, or not at all in segment 2; otherwise they would differ in 2 + 2 + 1 bits. So every fingerprint is entered
in three tables, one a segment, and probes those of segments 0 and 1 also at its neighbours: the values with one zero bit
set. Of two values one bit apart exactly one has the zero, so each pair meets once there. What meets is verified on all 64
bits, and a task hands on only a spanning forest of what it verified.

Work is done on different fingerprints, not on postings: copies, however many, are one entry. A bucket that holds more than
``BUCKET`` entries and probes is cut into cells that meet chunk by chunk. Before that the fingerprints of such buckets
are joined when they share a neighbour (one bit each), so that a dense cloud of near copies is one group already, and
within a bucket only pairs that don't both lie in its largest group are looked at. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.common import attach, bound_batches, written
from jobstrata.llm.components import components

WIDTH, SEED, RADIUS = 4, 42, 4
#: First bit, bits, radius.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
BUCKET = 20_000
_TASK = 100_000  # entries and probes that a Python call gets at once
_BLOCK = 1 << 20  # comparisons at once
_HASHES = 1 << 16  # shingle hashes at once


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: bit k is 1 if more than half of the hashes of its shingles have it. 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(words) - WIDTH + 1)]
    ends = ends[min(WIDTH, len(words)) - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        found = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _HASHES].tolist(), ends[at:at + _HASHES].tolist())]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(jobs: DataFrame) -> DataFrame:
    """id, fp (the 64 bits as a long) of every posting. Null texts count as empty."""
    id_type = jobs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("description_raw")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "fp"])

    return bound_batches(jobs.select("id", "description_raw")).mapInArrow(run, f"id {id_type}, fp long")


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _rows_of(number: int, first: int, bits: int, radius: int) -> Iterator[Column]:
    own = _segment(F.col("fp"), first, bits)

    def row(key: Column, entry: bool) -> Column:
        return F.struct(F.lit(number).alias("segment"), key.alias("key"), F.lit(entry).alias("entry"))

    yield F.array(row(own, True))
    if radius:
        unset = F.filter(F.array(*[F.lit(1 << b) for b in range(bits)]), lambda bit: own.bitwiseAND(bit) == 0)
        yield F.transform(unset, lambda bit: row(own.bitwiseOR(bit), False))


def postings_of_tables(prints: DataFrame) -> DataFrame:
    """segment, key, entry, fp: a row for each table's own value, and one for each neighbour to look at."""
    rows = F.concat(*[r for number, segment in enumerate(SEGMENTS) for r in _rows_of(number, *segment)])
    return prints.select("fp", F.explode(rows).alias("_row")).select("_row.*", "fp")


class Groups:
    """Disjoint sets of row numbers, merged an array of pairs at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _settle(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            self._settle()


def _forest(fp: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """a, b: fingerprints joined by the pairs of row numbers that differ in few enough bits, as few rows as join them."""
    distinct, place = np.unique(fp, return_inverse=True)
    groups = Groups(len(distinct))
    for a, b in pairs:
        near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        groups.merge(place[a[near]], place[b[near]])
    moved = np.flatnonzero(groups.root != np.arange(len(distinct)))
    return pa.table({"a": pa.array(distinct[groups.root[moved]].view(np.int64)), "b": pa.array(distinct[moved].view(np.int64))})


def _expanded(first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row k the pairs (k, first[k]), ..., (k, first[k] + counts[k] - 1), a block at a time."""
    through = np.concatenate([[0], np.cumsum(counts)])
    for at in range(0, int(through[-1]), _BLOCK):
        number = np.arange(at, min(at + _BLOCK, int(through[-1])))
        row = np.searchsorted(through, number, "right") - 1
        yield row, first[row] + number - through[row]


def _meet_buckets(table: pa.Table) -> pa.Table:
    """Whole buckets: each entry meets the entries before it, each probe all entries."""
    segment, key, entry, fp = (table.column(c).to_numpy() for c in ("segment", "key", "entry", "fp"))
    order = np.lexsort((~entry, key, segment))
    segment, key, entry, fp = segment[order], key[order], entry[order], fp[order].view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])]))
    sizes = np.diff(np.append(starts, len(key)))
    first = np.repeat(starts, sizes)
    entries = np.repeat(np.add.reduceat(entry.astype(np.int64), starts), sizes)
    return _forest(fp, _expanded(first, np.minimum(np.arange(len(key)) - first, entries)))


def _meet_cells(table: pa.Table) -> pa.Table:
    """One cell: its open rows meet its rows, at least one of the two an entry."""
    open_, entry, fp = (table.column(c).to_numpy() for c in ("open", "entry", "fp"))
    fp, left, right = fp.view(np.uint64), np.flatnonzero(open_), np.flatnonzero(~open_)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, _BLOCK // max(1, len(right)))
        for at in range(0, len(left), step):
            a, b = np.repeat(left[at:at + step], len(right)), np.tile(right, len(left[at:at + step]))
            met = entry[a] | entry[b]
            yield a[met], b[met]

    return _forest(fp, pairs())


def _neighbour_links(prints: DataFrame) -> DataFrame:
    """a, b: fingerprints that have a value at one bit's distance in common, each with the smallest of those around it.
    A value has 65 fingerprints around it at most, so no group is large."""
    bits = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    around = prints.select("fp", F.explode(F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("_value"))
    least = F.min("fp").over(Window.partitionBy("_value"))
    return around.select(least.alias("a"), F.col("fp").alias("b")).filter("a != b").distinct()


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of fingerprints that join what multi-index hashing finds within ``RADIUS`` bits. ``prints``: fp, distinct."""
    spark = prints.sparkSession
    rows = postings_of_tables(prints)
    sizes = rows.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("entry").alias("entries"))
    hot = written(sizes.filter((F.col("n") > bucket) & (F.col("entries") > 0)).select("segment", "key", "n"), "hot-buckets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-25 * prints.count() // _TASK))
    if not hot.take(1):
        tasks = rows.withColumn("_part", F.pmod(F.xxhash64("segment", "key"), F.lit(parts)))
        return written(tasks.groupBy("_part").applyInArrow(_meet_buckets, "a long, b long"), "links")
    marked = written(attach(rows, hot, ["segment", "key"], F.col("fp")), "bucket-rows")
    tasks = marked.filter("n is null").withColumn("_part", F.pmod(F.xxhash64("segment", "key"), F.lit(parts)))
    found = written(tasks.groupBy("_part").applyInArrow(_meet_buckets, "a long, b long"), "links")
    crowd = marked.filter("n is not null")
    near = written(_neighbour_links(crowd.select("fp").distinct()), "near-links")
    label = components(near).select(F.col("id").alias("fp"), "component")
    crowd = written(attach(crowd, label, ["fp"], F.xxhash64("segment", "key")).withColumn("component", F.coalesce("component", "fp")), "crowd")
    groups = crowd.groupBy("segment", "key", "component").count()
    main = groups.groupBy("segment", "key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("inside"))
    crowd = attach(crowd, main, ["segment", "key"], F.col("fp")).withColumn("rest", F.col("n") - F.col("inside"))
    # Open rows (outside the main group) meet all rows, chunk by chunk: cell (i, j) holds chunk i of the one, j of the other.
    chunks, others = (F.ceil(F.col(c) / F.lit(bucket)).cast("int") for c in ("n", "rest"))

    def dealt(side: DataFrame, own: Column, other: Column, is_open: bool) -> DataFrame:
        mine, all_ = F.pmod(F.xxhash64("fp"), own).cast("int"), F.explode(F.sequence(F.lit(0), other - 1))
        spread = side.select("*", mine.alias("_mine"), all_.alias("_other"))
        i, j = ("_mine", "_other") if is_open else ("_other", "_mine")
        return spread.select("segment", "key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(is_open).alias("open"), "entry", "fp")

    unsettled = crowd.filter("rest > 0")
    cells = dealt(unsettled.filter("component != main"), others, chunks, True).union(dealt(unsettled, chunks, others, False))
    late = written(cells.groupBy("segment", "key", "i", "j").applyInArrow(_meet_cells, "a long, b long"), "cell-links")
    return found.union(near).union(late)


def simhash_groups(jobs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links, its own included).

    Input: id of any orderable type, description_raw; other columns are ignored. Words are runs without ASCII white space, A-Z
    lower-cased; shingles are ``WIDTH`` words joined by blanks, or all words of a shorter text; null, empty and wordless texts have
    fingerprint zero and link like any other. Rows that repeat an id count one by one, each in the group of its own text. A
    posting without an id keeps its fingerprint, takes part in no group and has no component_id. An empty table gives no rows.
    """
    rows = written(fingerprints(jobs), "fingerprints")
    first = rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = written(first, "different-fingerprints")
    reach = written(components(links(first.select("fp"), bucket)), "fingerprint-groups")
    linked = first.join(reach, F.col("fp") == reach["id"]).select("fp", "first", "component")
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", "component_id")
    alone = first.filter("copies > 1").join(named, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    found = attach(rows, named.union(alone), ["fp"], F.col("id"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))
