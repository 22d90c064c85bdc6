"""Benchmark decontamination: no posting text may carry a passage of an evaluation item.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A benchmark window is ``width`` consecutive
words of an item; an item of fewer words is one window of its own length. Windows form a broadcast hash set, every window
of every posting probes it by a 64-bit hash, and each hit is verified on the words themselves. Texts are cut into
overlapping stretches of ``CHUNK`` window starts first, so that a probe carries a few words and not the text it comes from.
The benchmark has no counterpart among the index tables; it is general: item_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import let

WIDTH = 10
CHUNK = 128
#: Beyond so many windows the set is not broadcast: probes and windows are then shuffled by hash.
MAX_BROADCAST_WINDOWS = 2_000_000
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def _keys(hashes: Column, width: int) -> Column:
    """A 64-bit key for every window of ``width`` words that begins in a stretch, from the words' own hashes."""
    last = F.least(F.size(hashes) - width, F.lit(CHUNK - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per different window: its length, hash key, words and the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(width))
    starts = F.sequence(F.lit(0), F.size("_words") - length)
    cut = items.select("item_id", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("_words", i + 1, length))).alias("window"))
    return cut.groupBy("length", "window").agg(F.collect_set("item_id").alias("items")).select(
        "length", F.array_join("window", " ").alias("window_text"), "items",
        F.coalesce(*[F.when(F.col("length") == n, F.get(_keys(_hashes(F.col("window")), n), F.lit(0))) for n in range(1, width + 1)]).alias("key"),
    )


def find_passages(jobs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """For every posting: ``n_words``, ``hits`` (sorted start and length of each window found, in words) and ``items``.

    Null texts have no words. Repeated ids are told apart by their text, so equal copies give equal rows, each once per
    copy. The set of windows is counted first: it is small next to the corpus, but broadcast only within ``max_broadcast``.
    """
    windows = benchmark_windows(benchmark, width)
    lengths = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    text_key = F.xxhash64("description_raw").alias("_text")
    words = jobs.select("id", text_key, tokens(F.col("description_raw")).alias("_all")).select("id", "_text", "_all", F.size("_all").cast("long").alias("n_words"))
    bases = F.transform(F.sequence(F.lit(0), F.greatest(F.call_function("div", F.size("_all") - 1, F.lit(CHUNK)), F.lit(0)).cast("int")), lambda c: c * CHUNK)
    stretches = F.transform(bases, lambda base: F.struct(base.alias("base"), F.slice("_all", base + 1, F.lit(CHUNK + width - 1)).alias("words")))
    split = words.select("id", "_text", "n_words", F.explode(stretches).alias("_part")).select("id", "_text", "n_words", F.col("_part.base").alias("_base"), F.col("_part.words").alias("_words"))
    shuffled = sum(lengths.values()) > max_broadcast
    # Where windows are broadcast, a first probe of each posting always hits: it keeps those without any passage, so that
    # no second scan of the texts is needed. Where they are shuffled all those probes would meet under one key.
    first = (F.col("_base") == 0) & F.lit(not shuffled)
    always = F.when(first, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def probes(hashes: Column) -> Column:
        return F.concat(always, *[_keys(hashes, n) for n in sorted(lengths)])

    probed = split.select("id", "_text", "n_words", "_base", "_words", F.posexplode(let(_hashes(F.col("_words")), probes)).alias("_pos", "_key"))
    # Where a probe lies: all windows of the smallest length come first, then those of the next.
    passed = F.when(first, F.lit(1)).otherwise(F.lit(0))
    at, length = F.when(F.col("_pos") < passed, F.lit(-1)), F.when(F.col("_pos") < passed, F.lit(0))
    for n in sorted(lengths):
        here = F.greatest(F.least(F.size("_words") - n + 1, F.lit(CHUNK)), F.lit(0))
        at, length = at.when(F.col("_pos") < passed + here, F.col("_pos") - passed), length.when(F.col("_pos") < passed + here, F.lit(n))
        passed = passed + here
    sentinel = jobs.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit("").alias("window_text"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("key"))
    known = windows.select("length", "window_text", "items", "key")
    known = (known if shuffled else known.union(sentinel)).select(*[F.col(c).alias(f"w_{c}") for c in ("length", "window_text", "items", "key")])
    own_text = F.array_join(F.slice("_words", F.greatest(F.col("_at"), F.lit(0)) + 1, F.col("_length")), " ")
    place = (F.when(F.col("_at") >= 0, F.col("_base") + F.col("_at")).otherwise(-1)).cast("int").alias("_at")
    if shuffled:  # a probe travels with its own words only
        small = probed.withColumns({"_at": at, "_length": length}).select("id", "_text", "n_words", "_key", place, "_length", own_text.alias("_own"))
        hits = small.join(known, F.col("_key") == F.col("w_key"))
    else:
        hits = probed.join(F.broadcast(known), F.col("_key") == F.col("w_key")).withColumns({"_at": at, "_length": length})
        hits = hits.select("id", "_text", "n_words", place, "_length", own_text.alias("_own"), "w_length", "w_window_text", "w_items")
    hits = hits.filter((F.col("_length") == F.col("w_length")) & (F.col("_own") == F.col("w_window_text")))
    found = hits.groupBy("id", "_text").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("_at") < 0, True)).alias("_copies"),
        F.sort_array(F.collect_set(F.when(F.col("_at") >= 0, F.struct(F.col("_at").alias("at"), F.col("_length").alias("length"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"),
    )
    if shuffled:
        every = words.groupBy("id", "_text").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("_copies"))
        of = found.select(F.col("id").alias("_id"), F.col("_text").alias("_of"), "hits", "items")
        none = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("hits", "items")}
        found = every.join(of, every["id"].eqNullSafe(of["_id"]) & every["_text"].eqNullSafe(of["_of"]), "left").withColumns(none)
    copies = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select("id", "n_words", "hits", "items", F.col("_text").alias("text_key"))


def hit_words(hits: Column) -> Column:
    """Words inside any of the sorted windows."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))

    def step(done: Column, hit: Column) -> Column:
        end = F.greatest(done["end"], hit["at"] + hit["length"])
        return F.struct((done["n"] + end - F.greatest(done["end"], hit["at"])).cast("long").alias("n"), end.alias("end"))

    return F.aggregate(hits, start, step, lambda done: done["n"])


def contamination(jobs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, n_words, n_hit, items (sorted as strings), contaminated: one row per posting.

    Input: jobs(id, description_raw), benchmark(item_id, text); other columns are ignored. Null texts have no words and
    are clean; an empty benchmark leaves all postings clean; an empty index gives no rows.
    """
    found = find_passages(jobs, benchmark, width).withColumn("n_hit", hit_words(F.col("hits")))
    return found.select("id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def cut_passages(jobs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, description_raw with every word inside a hit removed, together with the characters up to the next word."""
    found = find_passages(jobs, benchmark, width).filter(F.size("hits") > 0).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "hits").dropDuplicates(["_id", "_key"])
    lowered = F.translate(F.col("description_raw"), UPPER, LOWER)
    pieces = F.regexp_extract_all("description_raw", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    head = F.regexp_extract(lowered, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)

    def kept(hits: Column) -> Column:
        return F.filter(
            F.transform(pieces, lambda piece, i: F.when(~F.exists(hits, lambda h: (h["at"] <= i) & (i < h["at"] + h["length"])), piece)),
            lambda piece: piece.isNotNull(),
        )

    rows = jobs.withColumn("_key", F.xxhash64("description_raw"))
    joined = rows.join(found, (rows["id"].eqNullSafe(found["_id"])) & (rows["_key"] == found["_key"]), "left")
    return joined.select("id", F.when(F.col("hits").isNull(), F.col("description_raw")).otherwise(F.concat(head, F.array_join(kept(F.col("hits")), ""))).alias("description_raw"))


def remove_contaminated(jobs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The postings, with all their columns, whose text carries no benchmark window. Null ids are kept apart by text."""
    bad = find_passages(jobs, benchmark, width).filter(F.size("hits") > 0).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = jobs.withColumn("_text_key", F.xxhash64("description_raw"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["_id"]) & (rows["_text_key"] == bad["_key"]), "left_anti").drop("_text_key")

