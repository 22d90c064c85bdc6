"""Quality rules with adaptive limits: each limit comes from the quantiles of the posting's own language and source.

Every measure of a description is an integer. Its sketch is a log-linear histogram: values below 128 are kept, larger
ones keep their 7 leading bits, so a quantile is off by less than 1/64 of itself, and sketches merge by adding counts.
Sketches of (language, source) groups merge into those of a language and of the whole index, which stand in for groups
with fewer than ``min_rows`` postings. Nothing depends on the order of rows, so reruns agree to the last bit.

Symbol rate and word length have fences around the middle half of their group, since what is wrong there can be more than a few
percent of it. Repeated words and lines are common in good texts of some sources and absent in others, so their limits
lie above the upper percentiles, by half the distance from the 95th to the 99th. Rates may exceed their limit by a single
occurrence in a posting of the group's median length, and by no fixed amount.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.common import attach, let, words_of, written

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("symbol_rate", "word_length", "repeat_rate", "dup_line_rate")
SKETCHED = (*MEASURES, "n_words")
PERCENTILES = (25, 50, 75, 95, 99)


@dataclass(frozen=True)
class Limits:
    """What the limits are made of; rates are per 1000 words or lines, the word length in hundredths of a character."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_rows: int = 100
    symbol_fence: int = 3  # quartile distances from the quartiles
    length_fence: int = 6


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by 64-bit hashes."""

    def covered(keys: Column) -> Column:
        def count(sorted_keys: Column) -> Column:
            def twin(entry: Column, i: Column) -> Column:
                before, after = F.get(sorted_keys, i - 1)["key"], F.get(sorted_keys, i + 1)["key"]
                return F.when((before == entry["key"]) | (after == entry["key"]), entry["at"])

            found = F.sort_array(F.filter(F.transform(sorted_keys, twin), lambda at: at.isNotNull()))
            return let(found, lambda at: F.aggregate(
                F.transform(at, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - v, F.lit(3)))),
                F.lit(0), lambda total, step: total + step,
            ))

        entries = F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.sort_array(entries), count))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    keys = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(keys, covered)).otherwise(F.lit(0))


def measures(jobs: DataFrame) -> DataFrame:
    """id, language, source and the counts of each whole description_raw."""
    text = F.coalesce("description_raw", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = jobs.select("id", "language", "source", words_of(text).alias("_words"), F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), lines.alias("_lines"))
    return counted.select(
        "id", "language", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("_words"), repeated_words).cast("long").alias("n_repeat_words"),
    )


def _rates(limits: Limits) -> dict[str, Column]:
    def per(top: str, bottom: str, scale: int) -> Column:
        return F.coalesce(F.call_function("div", F.lit(scale) * F.col(top), F.nullif(F.col(bottom), F.lit(0))), F.lit(0)).cast("long")

    n = F.col("n_words")
    return {
        "base_failed": (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * n),
        "symbol_rate": per("n_symbols", "n_words", 1000),
        "word_length": per("word_chars", "n_words", 100),
        "repeat_rate": per("n_repeat_words", "n_words", 1000),
        "dup_line_rate": per("n_dup_lines", "n_lines", 1000),
    }


def bucket_of(value: Column) -> Column:
    """The lower end of the sketch bucket that holds a non-negative value."""
    cut = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(rates: DataFrame) -> DataFrame:
    """Counts per language, source, measure and bucket, over all rows."""
    return (
        rates.select("language", "source", F.explode(F.create_map(*[x for m in SKETCHED for x in (F.lit(m), bucket_of(F.col(m)))])).alias("measure", "bucket"))
        .groupBy("language", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Rows of a group and, for each measure, its percentiles."""
    group = Window.partitionBy(*keys, "measure")
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumns({"_through": F.sum("n").over(running), "_all": F.sum("n").over(group)})
    found = [
        F.min(F.when((F.col("measure") == m) & (100 * F.col("_through") >= q * F.col("_all")), F.col("bucket"))).alias(f"{prefix}{m}_{q}")
        for m in SKETCHED for q in PERCENTILES
    ]
    return ranked.groupBy(*keys).agg(F.max("_all").alias(f"{prefix}rows"), *found)


def limits_of(sketch: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per language and source: ``max_`` of each measure and ``min_word_length``."""
    own = percentiles(sketch, ["language", "source"], "own_")
    by_language = percentiles(merged(sketch, ["language"]), ["language"], "language_").withColumnRenamed("language", "_language")
    overall = percentiles(merged(sketch, []), [], "all_")
    rows = own.join(by_language, F.col("language").eqNullSafe(F.col("_language")), "left")
    rows = rows.withColumn("_all", overall.select(F.struct(*overall.columns)).scalar())

    def at(measure: str, q: int) -> Column:
        name = f"{measure}_{q}"
        return (
            F.when(F.col("own_rows") >= limits.min_rows, F.col(f"own_{name}"))
            .when(F.col("language_rows") >= limits.min_rows, F.col(f"language_{name}"))
            .otherwise(F.col(f"_all.all_{name}"))
        )

    def fence(measure: str, width: int) -> Column:
        return width * (at(measure, 75) - at(measure, 25))

    def above(measure: str) -> Column:
        return at(measure, 99) + F.call_function("div", at(measure, 99) - at(measure, 95), F.lit(2)) + once

    once = F.call_function("div", F.lit(1000), at("n_words", 50))
    return rows.select(
        "language", "source",
        (at("symbol_rate", 75) + fence("symbol_rate", limits.symbol_fence) + once).alias("max_symbol_rate"),
        (at("word_length", 75) + fence("word_length", limits.length_fence)).alias("max_word_length"),
        (at("word_length", 25) - fence("word_length", limits.length_fence)).alias("min_word_length"),
        above("repeat_rate").alias("max_repeat_rate"), above("dup_line_rate").alias("max_dup_line_rate"),
    )


def judge_quality(jobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every posting.

    Input: id, description_raw, language, source; other columns are ignored. A null description has no words and fails
    the base rule; null languages and sources are groups of their own; repeated rows each count and are each returned;
    an empty table gives an empty result. Postings that pass the base rule feed the sketches. The counts, one narrow row
    per posting, are written to the shared folder once, since sketches and verdicts both read them.
    """
    rates = written(measures(jobs).withColumns(_rates(limits)), "quality-measures")
    limit = limits_of(sketches(rates.filter(~F.col("base_failed"))), limits)
    judged = attach(rates, limit, ["language", "source"], F.col("id"))
    # Limits are made of buckets' lower ends, so values are compared by their bucket.
    fits = bucket_of(F.col("word_length")) >= F.col("min_word_length")
    for m in MEASURES:
        fits = fits & (bucket_of(F.col(m)) <= F.col(f"max_{m}"))
    return judged.select(
        "id", "language", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", F.coalesce(~F.col("base_failed") & fits, F.lit(False)).alias("kept"),
    )
