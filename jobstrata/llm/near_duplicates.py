"""Near-duplicate postings by an LSH forest: groups of descriptions whose word shingles overlap by 75 % or more.

Every different shingle set has ``TREES * DEPTH`` MinHash values. Tree t sorts the sets by its own ``DEPTH`` values; a
region is a run of sets with a common prefix of ``PREFIX`` values, sorted in one task. In that order the sets with the longest
common prefix are next to each other, so a set's candidates are its ``WINDOW`` neighbours on either side. How long their common
prefix must be depends on the region: where more than ``CROWD`` sets share a prefix, one more value is asked for, and again, down
to the full depth. Of the neighbours whose estimate is high enough a maximum spanning forest is kept, at most one edge less than
sets, and confirmed on full shingle sets read from the texts.
A second pass takes every pair of a region that the estimate lets through and that the confirmed links don't join yet,
so that neither a candidate that failed nor one further off in the order is lost; where those pairs are many, the region's full sets meet in its task.
Sets of regions too large for a task are joined exactly instead, on the rare shingles that alike sets must share. Two sets of similarity s meet in a tree with probability s^3: at
0.75 all 20 trees miss a pair once in 55,000, at 0.8 once in 1.7 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.components import components
from jobstrata.llm.common import bound_batches, written
from jobstrata.llm.polyhash import mix
from jobstrata.llm.shingles import alike, shingle_sets

TREES, DEPTH, PREFIX = 20, 6, 3
PERCENT = 75
#: Estimates below these can't be 0.75 but by an error of more than 5 (candidates) or 4 (second pass) deviations.
LOOSE, CLOSE = 0.53, 0.58
#: In the first pass a region that holds more sets is entered at full depth; if it is still larger, it is dealt into parts, anew
#: in each tree. All sets of such regions meet in ``hot_pairs``, whichever path or part they were in.
REGION = 20_000
SALT = 20_000  # entries of one shingle, on each side, that meet in a task
_CODES = 1 << 20  # counters of shingles
DENSE = 4  # pairs per set up to which the second pass lists them
MAX_HOT = 100_000  # at most so many regions can hold more than their share of all rows
WINDOW, CROWD = 8, 32
_VALUES = TREES * DEPTH
_SEEDS = mix(np.arange(1, _VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash value; a row of zeros for an empty set."""
    out = np.zeros((len(sets), _VALUES), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        begins = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        with np.errstate(over="ignore"):
            for v, seed in enumerate(_SEEDS):
                least = np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), begins)
                out[full, v] = (least >> np.uint64(24)).astype(np.uint16)
    return out


def sketches(jobs: DataFrame) -> DataFrame:
    """id, n_shingles, digest of the whole set (null: empty), and the signature."""
    id_type = jobs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column("description_raw").to_pylist()))
                with np.errstate(over="ignore"):
                    digests = [np.array([s.sum(), mix(s ^ np.uint64(77)).sum(), len(s)], np.uint64).tobytes() if len(s) else None for s in sets]
                signed = signatures(sets).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in signed], pa.binary())],
                    ["id", "n_shingles", "digest", "signature"],
                )

    return bound_batches(jobs).select("id", "description_raw").mapInArrow(run, f"id {id_type}, n_shingles long, digest binary, signature binary")


def _places(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set and tree: tree and prefix, and the rest of the path, as 64-bit numbers."""
    paths = signature.reshape(-1, TREES, DEPTH).astype(np.int64)
    first = np.arange(TREES, dtype=np.int64)[None, :]
    for k in range(PREFIX):
        first = (first << 16) | paths[:, :, k]
    rest = np.zeros_like(first)
    for k in range(PREFIX, DEPTH):
        rest = (rest << 16) | paths[:, :, k]
    return first, rest


def trees(sets: DataFrame, with_bits: bool) -> DataFrame:
    """A row per set and tree: region, path, and (``with_bits``) id, n_shingles, 4 bits of each value and the group."""
    fields = "region long, path long"
    if with_bits:
        fields += f", id {sets.schema['id'].dataType.simpleString()}, n_shingles long, bits binary, known long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                signed = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(-1, _VALUES)
                region, path = _places(signed)
                columns = [pa.array(region.ravel()), pa.array(path.ravel())]
                if with_bits:
                    low = (signed & 15).astype(np.uint8)
                    bits = pa.array([r.tobytes() for r in (low[:, ::2] << 4) | low[:, 1::2]], pa.binary())
                    each = pa.array(np.repeat(np.arange(part.num_rows), TREES))
                    columns += [c.take(each) for c in (part.column("id"), part.column("n_shingles"), bits, part.column("known"))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    return sets.mapInArrow(run, fields)


def region_limit(sets: DataFrame) -> int:
    """So many sets a region may hold. Regions above are fewer than MAX_HOT, so broadcasting them is safe."""
    return max(REGION, sets.count() * TREES // MAX_HOT)


def hot_regions(sets: DataFrame, limit: int) -> DataFrame:
    """The regions of more than ``limit`` sets, as ``_region``."""
    return trees(sets, False).groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col("region").alias("_region"))


def _regions(sets: DataFrame, hot: DataFrame | None, limit: int, second: bool) -> DataFrame:
    """The tree rows with ``key``: region, or region and path where a region is too large, or a part of that. The second
    pass leaves such regions to ``hot_pairs``."""
    rows = trees(sets, True)
    columns = ["path", "id", "n_shingles", "bits", "known"]
    if hot is None:
        return rows.select(F.col("region").alias("key"), *columns)
    if second:
        return rows.join(F.broadcast(hot), F.col("region") == F.col("_region"), "left_anti").select(F.col("region").alias("key"), *columns)
    deep = trees(sets, False).join(F.broadcast(hot), F.col("region") == F.col("_region"), "left_semi").groupBy("region", "path").agg(F.count(F.lit(1)).alias("_n"))
    deep = deep.filter(F.col("_n") > limit).select(F.col("region").alias("_deep_region"), F.col("path").alias("_deep_path"), F.ceil(F.col("_n") / limit).cast("long").alias("_parts"))
    placed = rows.join(F.broadcast(hot), F.col("region") == F.col("_region"), "left")
    placed = placed.join(F.broadcast(deep), (F.col("region") == F.col("_deep_region")) & (F.col("path") == F.col("_deep_path")), "left")
    part: Column = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("id", "region"), F.col("_parts"))).otherwise(F.lit(0))
    key = F.when(F.col("_region").isNull(), F.col("region")).otherwise(F.xxhash64("region", "path", part))
    return placed.select(key.alias("key"), *columns)


def _codes(texts: DataFrame) -> np.ndarray:
    """For each counter, the logarithm of how often its shingles occur in ``texts``, in steps of an eighth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CODES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for s in shingle_sets(batch.column("description_raw")[at:at + 256].to_pylist()):
                    np.add.at(counts, (s & np.uint64(_CODES - 1)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            part = some[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["code", "n"])

    total = texts.select("description_raw").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_CODES, np.uint8)
    out[total.column("code").to_numpy()] = np.minimum(255, 1 + 8 * np.log2(total.column("n").to_numpy()))
    return out


def rare_shingles(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, known, shingle, n (shingles of the set) and reach (those from this one on, rare ones first): a row per shingle
    that can be the first one that the set shares with another alike to it.

    The order is by estimated frequency, then hash. Any order gives all pairs, as long as all sets have the same one.
    """
    codes, id_type = _codes(texts), texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shingles, reaches, sizes = [], [], []
                for s in shingle_sets(part.column("description_raw").to_pylist()):
                    order = np.argsort(codes[(s & np.uint64(_CODES - 1)).astype(np.int64)], kind="stable")
                    reach = len(s) - np.arange(len(s))
                    own = 100 * reach >= percent * len(s)
                    shingles.append(s[order[own]].view(np.int64))
                    reaches.append(reach[own])
                    sizes.append(len(s))
                many = [len(s) for s in shingles]
                each = pa.array(np.repeat(np.arange(part.num_rows), many))
                columns = [part.column("id").take(each), part.column("known").take(each), pa.array(np.concatenate(shingles)), pa.array(np.repeat(np.array(sizes, np.int64), many)), pa.array(np.concatenate(reaches).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "known", "shingle", "n", "reach"])

    return texts.select("id", "known", "description_raw").mapInArrow(run, f"id {id_type}, known long, shingle long, n long, reach long")


def hot_pairs(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs a < b of different groups that may be alike, none missing. ``texts``: id, known, description_raw, a row per set.

    Alike sets of sizes n and m share percent / (100 + percent) * (n + m) shingles, so from their first common one on both
    have as many left: sets of one template that differ too much don't meet at the template's shingles. Shingles of many
    sets are dealt out in cells of SALT entries of each side.
    """
    entries = written(rare_shingles(texts, percent), "rare")
    is_small = (100 + percent) * F.col("reach") >= 2 * percent * F.col("n")  # can be the smaller set of a pair
    sides = entries.groupBy("shingle").agg(F.count_if(is_small).alias("smalls"), F.count(F.lit(1)).alias("alls"))
    # Fewer than entries / SALT shingles.
    full = written(sides.filter((F.col("alls") > SALT) & (F.col("smalls") > 0)).select(F.col("shingle").alias("_full"), F.ceil(F.col("smalls") / SALT).alias("_smalls"), F.ceil(F.col("alls") / SALT).alias("_alls")), "full")
    parts = entries.join(F.broadcast(full), F.col("shingle") == F.col("_full"), "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_smalls", "_alls")})

    def dealt(own: str, other: str) -> Column:
        mine = F.pmod(F.xxhash64("id"), F.col(own))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col(other) - 1), lambda k: F.struct(mine.alias(own), k.alias(other)))
        return F.explode(cells)

    left = parts.filter(is_small).select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("id", "known", "n", "reach")], dealt("_smalls", "_alls").alias("cell"))
    left = left.select("*", F.col("cell._smalls").alias("_s"), F.col("cell._alls").alias("_t")).drop("cell")
    right = parts.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("id", "known", "n", "reach")], dealt("_alls", "_smalls").alias("cell"))
    right = right.select("*", F.col("cell._smalls").alias("_s"), F.col("cell._alls").alias("_t")).drop("cell")
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    enough = (100 + percent) * F.least("reach_a", "reach_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = left.join(right, ["shingle", "_s", "_t"]).filter(first & enough & (100 * F.col("n_a") >= percent * F.col("n_b")) & (F.col("known_a") != F.col("known_b")))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from 4 bits per value, corrected for chance hits."""
    return ((one == many).mean(axis=-1) - 1 / 16) * (16 / 15)


def _possible(n: np.ndarray, k: int | slice, other: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n[k], other) >= PERCENT * np.maximum(n[k], other)


def depths(path: np.ndarray) -> np.ndarray:
    """For each set of a region, in path order, how many further values a neighbour must share: the fewest such that at most
    ``CROWD`` sets have them in common, at most all there are."""
    found = np.zeros(len(path), np.int64)
    for d in range(DEPTH - PREFIX):
        run = path >> (16 * (DEPTH - PREFIX - d))
        begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sizes = np.diff(np.append(begins, len(path)))
        found[(found == d) & (np.repeat(sizes, sizes) > CROWD)] = d + 1
    return found


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values of the rest of two paths agree."""
    return sum(((a >> (16 * k)) == (b >> (16 * k))).astype(np.int64) for k in range(DEPTH - PREFIX))


def neighbours(path: np.ndarray, bits: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Candidates of a region in path order: a maximum spanning forest, by estimate, of the pairs of neighbours whose common
    prefix is long enough; ties go to the longer prefix, then to earlier sets."""
    depth, first, second, near, shared = depths(path), [], [], [], []
    for step in range(1, min(WINDOW, len(path) - 1) + 1):
        i = np.arange(len(path) - step)
        prefix = common(path[i], path[i + step])
        i = i[(prefix >= np.maximum(depth[i], depth[i + step])) & _possible(n, i, n[i + step])]
        guess = estimate(bits[i], bits[i + step])
        i, guess = i[guess >= LOOSE], guess[guess >= LOOSE]
        first.append(i)
        second.append(i + step)
        near.append(guess)
        shared.append(common(path[i], path[i + step]))
    a, b, guess, prefix = (np.concatenate(v) for v in (first, second, near, shared))
    order = np.lexsort((b, a, -prefix, -guess))
    parent, edges = list(range(len(path))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(a[order].tolist(), b[order].tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((x, y))
    return edges


def unjoined(bits: np.ndarray, n: np.ndarray, known: np.ndarray) -> list[tuple[int, int]] | None:
    """All pairs of different groups whose estimate is at least CLOSE; None if they are more than DENSE per set."""
    names, group, size = np.unique(known, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return []
    edges: list[tuple[int, int]] = []
    for k in np.flatnonzero(group != size.argmax()).tolist():  # the largest group meets each of the others from their side
        for at in range(0, len(bits), 1 << 14):
            part = slice(at, at + (1 << 14))
            other = group[part] != group[k]
            later = (np.arange(at, at + len(other)) > k) | (group[part] == size.argmax())
            rows = np.flatnonzero(other & later & _possible(n, k, n[part]))
            near = rows[estimate(bits[k], bits[part][rows]) >= CLOSE]
            edges += [(k, at + j) for j in near.tolist()]
        if len(edges) > DENSE * len(bits):
            return None
    return edges


def joins(sets: list[np.ndarray], known: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between different groups, at most one less than there are groups, from the full sets.

    The sets outside the largest group meet all others through the places of their shingles: exact sizes of all
    intersections of one set at a time, and no pairs but the links.
    """
    names, group, size = np.unique(known, return_inverse=True, return_counts=True)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[by], np.arange(len(shingles) + 1))
    place = np.concatenate([[0], np.cumsum(lengths)])
    parent = list(range(len(names)))

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    links = []
    for k in np.flatnonzero(group != size.argmax()).tolist():
        own = code[place[k]:place[k + 1]]
        counts = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owner[by[at]], minlength=len(sets))
        near = np.flatnonzero(100 * both >= percent * (lengths + lengths[k] - both))
        for j in near.tolist():
            a, b = root(group[j]), root(group[k])
            if a != b:
                parent[a] = b
                links.append((k, j))
    return links


def candidates(sets: DataFrame, hot: DataFrame | None, limit: int, second: bool) -> DataFrame:
    """Pairs a < b of sets worth confirming; ``known`` is the group of each set so far, ``hot`` the regions above ``limit``.

    In the second pass a region with too many pairs to list gives its members instead: rows with ``key``, the member as
    ``a`` and its group as ``known``.
    """
    id_type = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column("key").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
            ends = np.append(begins[1:], len(keys))
            many = ends - begins > 1
            if not many.any():
                return
            packed = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(keys), -1)
            n, known, paths = (table.column(c).to_numpy() for c in ("n_shingles", "known", "path"))
            pairs: list[tuple[int, int]] = []
            members: list[int] = []
            two = begins[many & (ends - begins == 2)]
            if len(two):
                a, b = unpacked(packed[two]), unpacked(packed[two + 1])
                good = (estimate(a, b) >= (CLOSE if second else LOOSE)) & _possible(n, two, n[two + 1])
                if second:
                    good &= known[two] != known[two + 1]
                pairs += [(int(k), int(k) + 1) for k in two[good]]
            more = many & (ends - begins > 2)
            for a, b in zip(begins[more].tolist(), ends[more].tolist()):
                if second and (known[a:b] == known[a]).all():
                    continue
                bits = unpacked(packed[a:b])
                some = unjoined(bits, n[a:b], known[a:b]) if second else neighbours(paths[a:b], bits, n[a:b])
                if some is None:
                    members += range(a, b)
                else:
                    pairs += [(x + a, y + a) for x, y in some]
            ids = table.column("id").combine_chunks()
            one, other, member = (pa.array(v, pa.int64()) for v in ([p[0] for p in pairs], [p[1] for p in pairs], members))
            columns = [pa.concat_arrays([ids.take(one), ids.take(member)]), pa.concat_arrays([ids.take(other), pa.nulls(len(member), ids.type)])]
            for values in (keys, known):
                columns.append(pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(values[members] if members else [], pa.int64())]))
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "known"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # rows come sorted by key: the last region may go on
            if cut or (held and held[-1].column("key")[0].as_py() != keys[0]):
                yield from found_in(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from found_in(pa.Table.from_batches(held))

    rows = _regions(sets, hot, limit, second).repartition("key").sortWithinPartitions("key", "path", "id")
    found = rows.mapInArrow(run, f"a {id_type}, b {id_type}, key long, known long")
    is_pair = F.col("key").isNull()
    return found.select(F.when(is_pair, F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(is_pair, F.greatest("a", "b")).alias("b"), "key", "known").distinct()


def dense_links(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between groups within each region of ``members`` (key, id, known), confirmed on full sets in its task; a
    region has at most ``region_limit`` sets."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(table.column("description_raw").to_pylist()))
        found = joins(sets, table.column("known").to_numpy(), percent)
        ids = table.column("id").combine_chunks()
        return pa.table({name: ids.take(pa.array([p[k] for p in found], pa.int64())) for k, name in enumerate("ab")})

    return members.join(texts, "id").groupBy("key").applyInArrow(run, f"a {id_type}, b {id_type}")


def unpacked(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), _VALUES), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets overlap enough. ``texts``: id, description_raw, one row per set."""
    left = texts.select(F.col("id").alias("a"), F.col("description_raw").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("description_raw").alias("text_b"))
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                first = shingle_sets(part.column("text_a").to_pylist())
                good = [alike(a, b, percent) for a, b in zip(first, shingle_sets(part.column("text_b").to_pylist()))]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {id_type}, b {id_type}")


def near_duplicates(jobs: DataFrame) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links) and kept (id = component_id).

    Input: id (unique, of any orderable type), description_raw; other columns are ignored. Null, empty and wordless texts
    have no shingles and no links; a posting without an id is left on its own and kept, with no component_id. Equal sets, however many, form one class under its smallest id before any comparison.
    An empty table gives no rows. Intermediate tables are written to the shared folder.
    """
    rows = written(sketches(jobs), "sketches")
    classes = rows.filter("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "signature")).alias("_first")).select("digest", "_first.*")
    first = written(classes.select("digest", "id", "n_shingles", "signature"), "classes")
    sets = first.select("id", "n_shingles", "signature", F.lit(0).cast("long").alias("known"))
    limit = region_limit(sets)
    hot = written(hot_regions(sets, limit), "hot")
    hot = hot if hot.take(1) else None
    pairs = written(candidates(sets, hot, limit, second=False).select("a", "b"), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if hot is not None:
        crowd = written(trees(sets, True).join(F.broadcast(hot), F.col("region") == F.col("_region"), "left_semi").select("id").distinct(), "crowd")
        nodes = nodes.union(crowd)
    nodes = nodes.distinct()
    # Ids and texts both grow with the postings, so the join is stated and not left to the size of the ids on the day.
    texts = written(jobs.select("id", "description_raw").join(nodes.hint("merge"), "id", "left_semi"), "texts")
    links = written(confirmed(pairs, texts), "links")
    groups = written(components(links), "groups")
    # What the first pass left apart: the group of a set is told by a hash of its component.
    apart = first.join(nodes, "id", "left_semi").join(groups, "id", "left").select("id", "n_shingles", "signature", F.xxhash64(F.coalesce("component", "id")).alias("known"))
    apart = written(apart, "apart")
    more = written(candidates(apart, hot, limit, second=True), "more")
    new = more.filter("key is null").select("a", "b")
    if hot is not None:
        new = new.union(hot_pairs(texts.join(apart.select("id", "known").join(crowd, "id", "left_semi"), "id"))).distinct()
    late = confirmed(new.join(pairs, ["a", "b"], "left_anti"), texts)
    dense = dense_links(more.filter("key is not null").select("key", F.col("a").alias("id"), "known"), texts)
    late = written(late.union(dense), "late-links")
    groups = components(links.union(late)) if late.take(1) else groups
    final = first.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    found = rows.select("id", "n_shingles", "digest").join(final, "digest", "left")
    own = found.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return own.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(jobs: DataFrame) -> DataFrame:
    """The postings, with all their columns, that come first in their group of near duplicates."""
    later = near_duplicates(jobs).filter(~F.col("kept")).select(F.col("id").alias("_later"))
    return jobs.join(later, F.col("id") == F.col("_later"), "left_anti")
