"""Mixing the sources of the index to target weights, in fixed-length blocks of words.

The texts of a source, in a pseudorandom order, form one stream that is cut into blocks of ``block_words`` words. The
targets say how many slots each source gets in all; a keyed permutation of all slots deals them to output shards of
``shard_slots`` slots. So the source counts of a shard are a multinomial draw, conditioned on the totals: no source is drawn
beyond its passes, and totals meet the targets. The j-th slot of a source takes the block at position j of that source's own
index permutation (another one for each pass), so no block is taken more often than another by more than one. Slots and blocks meet
in a join on (source, block).

Permutations are exact for any number of indices and need no memory: ``ROUNDS`` rounds of swap-or-not, in each of which every
index is paired with its mirror image about a keyed point, and a keyed pseudorandom bit of the pair says whether they swap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.common import attach, words_of
from jobstrata.operators.scans import global_order

#: Keys and bits are worked out modulo this prime, so that products fit 64 bits; fixed multipliers per use.
PRIME = 2**31 - 1
MULTIPLIERS = (1103515245, 1566083941, 1664525, 22695477)
INNER = 1_000_003
ROUNDS = 16
SLOTS_PER_STEP = 4096


@dataclass(frozen=True)
class Mix:
    """Sources in code-point order, null last, weigh ``weights`` in turn and share ``share_percent`` of all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    max_passes: int = 2
    block_words: int = 64
    shard_slots: int = 1024
    seed: int = 7


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _key(use: int, turn: Column, shift: Column) -> Column:
    """1 .. PRIME - 1, by round and shift."""
    return (turn * MULTIPLIERS[use] + (shift % PRIME) * MULTIPLIERS[(use + 1) % 4] + 7919 * (use + 1)) % (PRIME - 1) + 1


def round_keys(size: Column, shift: Column) -> Column:
    """The keys of all rounds: centre, and factor and offset of the bit. Worked out once for many indices."""
    size, shift = size.cast("long"), shift.cast("long")

    def keys(turn: Column) -> Column:
        # The centre is below the size, also where that has more than 31 bits.
        centre = (_key(0, turn, shift) * _key(1, turn, shift)) % size
        return F.struct(centre.alias("centre"), _key(2, turn, shift).alias("factor"), _key(3, turn, shift).alias("offset"))

    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), keys)


def swapped(index: Column, size: Column, keys: Column) -> Column:
    """A bijection of 0 .. size - 1, given its round keys."""
    size = size.cast("long")

    def round_(at: Column, key: Column) -> Column:
        mirror = (key["centre"] - at + size) % size
        # Two moduli: a single one would leave the bits of neighbouring pairs too regular.
        bits = ((F.greatest(at, mirror) % PRIME * key["factor"] + key["offset"]) % PRIME % INNER * key["factor"] + key["offset"]) % PRIME
        return F.when(_div(bits, 256) % 2 == 1, mirror).otherwise(at)

    return F.aggregate(keys, index.cast("long"), round_)


def permuted(index: Column, size: Column, shift: Column) -> Column:
    """A bijection of 0 .. size - 1, another one for each ``shift`` (not negative)."""
    return swapped(index, size, round_keys(size, shift))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, place, source_size, target: shares by weight; what exceeds ``max_passes`` times a source goes to the others.

    Sharing the excess again until none is above comes down to one level: sources in the order of size per weight are
    full as long as the level of the rest still exceeds their own. One row per source meets in a window here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in mix.weights]), (place % len(mix.weights)).cast("int"))
    cap = mix.max_passes * F.col("source_size")
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_source.withColumn("_place", place).withColumns({"_weight": weight, "_cap": cap.cast("double")})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    ranked = ranked.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)),
        "_weight_left": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0)),
        "_total": F.sum("source_size").over(everything) * F.lit(mix.share_percent / 100.0),
    })
    ranked = ranked.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weight_left"))
    # The first source that is not full sets the level of all after it.
    level = F.min_by("_level", F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_place"))).over(everything)
    return ranked.select("source", F.col("_place").alias("place"), "source_size", F.when(F.col("_ratio") <= F.col("_level"), F.col("_cap")).otherwise(F.coalesce(level, F.col("_level")) * F.col("_weight")).alias("target"))


def layout(jobs: DataFrame, mix: Mix = Mix(), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Postings with their place in their source's stream, and the sources with their targets, blocks and draws.

    The order within a source follows the MD5 of the id (``key``), so it depends on nothing but the ids (and, for
    repeated ids, the sizes). Running totals come from range-partitioned ranges: no source is ever gathered in one task.
    """
    sized = jobs.select("id", "source", F.size(words_of(F.col("description_raw"))).cast("long").alias("size"))
    spread = sized.withColumns({"_no_source": F.col("source").isNull().cast("int"), "_shuffled": F.md5(F.col(key).cast("string"))})
    placed = global_order(spread, ["_no_source", "source", "_shuffled", "id", "size"], {"_through": "size"})
    placed = placed.select(F.col("rank").alias("row"), "id", "source", "size", "_through")
    plan = targets(placed.select("source", "size"), mix)
    begins = placed.groupBy("source").agg(F.min(F.col("_through") - F.col("size")).alias("_begin")).withColumnRenamed("source", "_source")
    blocks = F.ceil(F.col("source_size") / F.lit(float(mix.block_words)))
    draws = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), mix.max_passes * F.col("blocks"))
    sources = (
        plan.join(begins, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("blocks", blocks.cast("long"))
        .withColumn("draws", F.coalesce(F.when(F.col("source_size") > 0, draws), F.lit(0).cast("long")))
    )
    rows = attach(placed, sources.select("source", "source_size", "target", "_begin"), ["source"], F.col("row"))
    ends = F.col("_through") - F.col("_begin")
    return rows.select("row", "id", "source", "size", "source_size", "target", (ends - F.col("size")).alias("begin"), ends.alias("end")), sources


def segments(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What each block holds: row, id, source, block, and the words ``from_word`` to ``to_word`` (exclusive) of the posting."""
    n = F.lit(mix.block_words)
    first, last = F.call_function("div", F.col("begin"), n), F.call_function("div", F.col("end") - 1, n)
    cut = rows.filter(F.col("size") > 0).select("row", "id", "source", "begin", "end", F.explode(F.sequence(first, last)).alias("block"))
    return cut.select(
        "row", "id", "source", "block",
        (F.greatest(F.col("begin"), F.col("block") * n) - F.col("begin")).alias("from_word"),
        (F.least(F.col("end"), (F.col("block") + 1) * n) - F.col("begin")).alias("to_word"),
    )


def slots(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """shard, slot, source, pass, block: what the mixture takes, slot by slot."""
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sources.withColumns({"_first": F.coalesce(F.sum("draws").over(earlier), F.lit(0)), "_slots": F.sum("draws").over(Window.partitionBy(F.lit(0)))})
    # A hot source has most of the slots: its steps, not the source, are dealt over the tasks before they are numbered.
    # A step lies within one pass, so its slots share their round keys.
    step, zero = F.lit(SLOTS_PER_STEP), F.lit(0).cast("long")
    passes = placed.filter("draws > 0").withColumn("pass", F.explode(F.sequence(zero, _div(F.col("draws") - 1, F.col("blocks")))))
    passes = passes.withColumn("_in_pass", F.least(F.col("blocks"), F.col("draws") - F.col("pass") * F.col("blocks")))
    steps = passes.withColumn("_step", F.explode(F.sequence(zero, _div(F.col("_in_pass") - 1, step))))
    # A row stands for thousands of slots, so the number of tasks is stated: by size they would be merged into one.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = steps.repartition(tasks, "source", "pass", "_step").withColumns({
        "_block_keys": round_keys(F.col("blocks"), mix.seed + 104729 * F.col("place").cast("long") + 15485863 * F.col("pass")),
        "_slot_keys": round_keys(F.col("_slots"), F.lit(mix.seed)),
    })
    drawn = keyed.withColumn("_at", F.explode(F.sequence(F.col("_step") * step, F.least((F.col("_step") + 1) * step, F.col("_in_pass")) - 1)))
    slot = swapped(F.col("_first") + F.col("pass") * F.col("blocks") + F.col("_at"), F.col("_slots"), F.col("_slot_keys"))
    return drawn.select(
        _div(slot, mix.shard_slots).alias("shard"), slot.alias("slot"), "source", "pass", swapped(F.col("_at"), F.col("blocks"), F.col("_block_keys")).alias("block"),
    )


def shard_counts(taken: DataFrame) -> DataFrame:
    """shard, source, n: how many slots of each shard go to each source."""
    return taken.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n"))


def mixture(jobs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed index: one row per slot and piece of a posting in its block, with shard, slot, source, pass, block,
    row, id, from_word, to_word."""
    rows, sources = layout(jobs, mix)
    parts = segments(rows, mix)
    return _met(slots(sources, mix), parts).select("shard", "slot", "source", "pass", "block", "row", "id", "from_word", "to_word")


def _met(taken: DataFrame, parts: DataFrame) -> DataFrame:
    """Slots look as small to the planner as the sources they are exploded from, but grow with the index: without the
    hint they would be broadcast."""
    held = parts.withColumnsRenamed({"source": "_source", "block": "_block"})
    return taken.hint("merge").join(held, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")


def mixed_sizes(jobs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """id, size, source_size, target and ``taken``, the words the mixture takes of each posting, repeats counted.

    Input: id, description_raw, source; other columns are ignored. Null texts and texts without words have size 0 and are
    never taken; a null source is a source; repeated rows are separate postings; an empty table gives an empty result.
    """
    rows, sources = layout(jobs, mix)
    times = slots(sources, mix).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    met = _met(times, segments(rows, mix))
    taken = met.groupBy("row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(jobs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The postings as the mixture takes them, with all their columns: a row for each pass over a posting, holding the
    words taken in it with the white space before them. Equal (id, source, text) rows are interchangeable."""
    same = Window.partitionBy("id").orderBy("source", F.md5("description_raw"))
    keyed = jobs.withColumn("_copy", F.row_number().over(same))
    named = keyed.select(F.struct("id", "_copy").alias("id"), "source", "description_raw")
    rows, sources = layout(named, mix, "id.id")
    parts = segments(rows, mix)
    met = _met(slots(sources, mix), parts)
    cuts = met.groupBy(F.col("id.id").alias("_id"), F.col("id._copy").alias("_copy_taken"), "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_cuts"))
    pieces = F.regexp_extract_all("description_raw", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))

    def text(words: Column) -> Column:
        return F.array_join(F.transform("_cuts", lambda c: F.array_join(F.slice(words, c["from_word"].cast("int") + 1, (c["to_word"] - c["from_word"]).cast("int")), "")), "")

    joined = keyed.join(cuts, keyed["id"].eqNullSafe(cuts["_id"]) & (keyed["_copy"] == cuts["_copy_taken"]))
    mixed = F.get(F.transform(F.array(pieces), text), F.lit(0))
    return joined.select(*[mixed.alias(c) if c == "description_raw" else keyed[f"`{c}`"] for c in jobs.columns])
