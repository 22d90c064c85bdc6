"""What each of five text filters removes from a table of postings, in every order in which they could be applied.

The counts behind the filters come from one pass of a byte transducer over each whole text (``word_transducer``). A posting
is then no more than the set of filters it fails, one of 32; postings are counted per source and set, and all orders and
steps follow from those 32 numbers: a step removes the sets that hold its filter and none of the filters before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.common import bound_batches
from jobstrata.llm.word_transducer import count_texts

#: Fixed values of the audit.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5

SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_counts(jobs: DataFrame) -> DataFrame:
    """id, source, text_key (SHA-256 of the text), n_words, n_distinct, n_capitals, n_points, n_symbols of every posting."""
    fields = {f.name: f.dataType.simpleString() for f in jobs.select("id", "source").schema}
    text = F.coalesce("description_raw", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_texts(batch.column("_text").to_pylist())
            names = ["id", "source", "text_key", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + [pa.array(np.ascontiguousarray(c)) for c in found], names)

    rows = bound_batches(jobs.select("id", "source", F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("_text")))
    schema = f"id {fields['id']}, source {fields['source']}, text_key binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"
    return rows.mapInArrow(run, schema)


def _failed(*conditions: Column) -> Column:
    """The set of filters as a number: bit k is filter k."""
    total = F.lit(0)
    for k, condition in enumerate(conditions):
        total = total + F.when(condition, F.lit(1 << k)).otherwise(0)
    return total.cast("int")


def failures(jobs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, failed, good, toxic, n: how many postings of a source fail exactly which filters.

    A is under 50 words, B fewer than 65 % different words, C more than 5 % capitals, D a symbol, E a text that a smaller id has
    as well. ``labels``: id, quality, toxic; an id with several rows is good (toxic) if one of them says so.
    """
    alone = _failed(
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    )
    # Equal rows are counted first, so that neither a repeated id nor a repeated text travels row by row.
    rows = text_counts(jobs).select("id", F.coalesce("source", F.lit("")).alias("source"), "text_key", alone.alias("failed")).groupBy("id", "source", "text_key", "failed").count()
    marks = labels.groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("id is not null")
    marked = rows.join(marks, "id", "left").select("id", "source", "text_key", "failed", "count", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # Per text, source and labels: all rows, and those with the smallest id.
    kinds = marked.groupBy("text_key", "source", "failed", "good", "toxic").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("count")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "count"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("text_key"))
    original = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.count")).otherwise(0)
    split = kinds.withColumn("least", least).select(
        "source", "good", "toxic",
        F.explode(F.array(F.struct(F.col("failed"), original.alias("n")), F.struct((F.col("failed") + F.lit(SETS // 2)).alias("failed"), (F.col("n") - original).alias("n")))).alias("part"),
    )
    return split.filter("part.n > 0").groupBy("source", "part.failed", "good", "toxic").agg(F.sum("part.n").alias("n"))


def audit_filters(jobs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per source,
    order of the five filters and step of it, zeros included.

    Input: id of any orderable type, description_raw, source; ``labels``: id, quality, toxic. Other columns are ignored. Null texts
    count as empty, a null source as ''. Repeated rows count one by one; rows with the same id and text don't make each other
    fail E. Postings without an id fail E never and make no other fail it; they have no labels. An empty table gives no rows.
    """
    counts = failures(jobs, labels)
    sums = [F.array(*[F.sum(F.when((F.col("failed") == k) & keep, F.col("n")).otherwise(0)) for k in range(SETS)]).alias(name)
            for name, keep in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    per_source = counts.groupBy("source").agg(*sums)
    orders = F.split(F.lit(" ".join(ORDERS)), " ")
    steps = per_source.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(c), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))

    own = bits(F.col("filter_order").substr(F.col("step"), F.lit(1)))
    before = bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1))
    placed = steps.select("*", own.alias("_own"), before.alias("_before"))

    def total(name: str, wanted) -> Column:
        """Sum over the sets k for which ``wanted`` gives a factor."""
        return F.aggregate(F.transform(name, lambda n, k: n * wanted(k)), F.lit(0).cast("long"), lambda a, b: a + b)

    def here(k: Column) -> Column:
        return ((k.bitwiseAND(F.col("_own")) != 0) & (k.bitwiseAND(F.col("_before")) == 0)).cast("long")

    def late(k: Column) -> Column:
        return ((k.bitwiseAND(F.col("_own")) != 0) & (k.bitwiseAND(F.col("_before")) != 0)).cast("long")

    def left(k: Column) -> Column:
        return (k.bitwiseAND(F.col("_own").bitwiseOR(F.col("_before"))) == 0).cast("long")

    def share(k: Column) -> Column:
        """In how many of all orders the filter is the first of those that the set fails."""
        return F.when(k.bitwiseAND(F.col("_own")) != 0, F.lit(len(ORDERS)) / F.greatest(F.bit_count(k), F.lit(1))).otherwise(0).cast("long")

    return placed.select(
        "source", "filter_order", "step",
        total("all", left).alias("kept"), total("all", here).alias("removed"), total("all", late).alias("redundant"),
        F.get("all", F.col("_own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("all", share).alias("shapley"),
    )
