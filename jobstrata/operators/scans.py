"""Running values over ordered rows that survive a key holding a large share of all rows.

A plain window puts every row of a key into one task. Here the order is cut into blocks: rows are
folded inside their block, one summary row per block carries the earlier blocks' result over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.session import ensure_checkpoint_dir

BLOCK = 4096
RANGES = 1024
_BEFORE = (Window.unboundedPreceding, -1)


def fold_before(
    df: DataFrame,
    keys: list[str],
    position: Column,
    value: Column,
    out: str,
    how: str = "min",
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``out``: the min, or the last non-null, of ``value`` over the rows of the same keys
    with a smaller integer ``position``; null where there is none. Positions are distinct per key,
    so no block exceeds ``block`` rows, however many rows a key has.
    """
    rows = df.withColumns({"_at": position.cast("bigint"), "_value": value}).withColumn(
        "_block", F.expr(f"_at div {int(block)}") - (F.col("_at") % block < 0).cast("bigint")
    )
    of_block = {
        "min": F.min("_value"),
        "last": F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))),
    }[how]
    running = {"min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*_BEFORE)
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(of_block.alias("_sum"))
        .select(*keys, "_block", running("_sum").over(earlier).alias("_carried"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(*_BEFORE)
    folded = rows.withColumn("_inside", running("_value").over(inside)).join(
        carried, [*keys, "_block"], "left"
    )
    result = {
        "min": F.least("_inside", "_carried"),
        "last": F.coalesce("_inside", "_carried"),
    }[how]
    return folded.withColumn(out, result).drop(
        "_at", "_value", "_block", "_inside", "_carried"
    )


def key_cuts(df: DataFrame, key: Column, ranges: int) -> Column:
    """At most ``ranges`` - 1 sorted keys that cut a table into ranges of about equal size, as a scalar subquery.

    They are the keys of least hash: an even sample that every partition takes its part of, that depends on nothing but the
    keys, and that needs no pass over the table before the plan is made. Few rows of each partition travel.
    """
    keyed = df.select(key.alias("_key"))
    chosen = keyed.orderBy(F.xxhash64("_key"), "_key").limit(max(1, ranges - 1))
    return chosen.agg(F.array_sort(F.collect_set("_key"))).scalar()


def range_of(cuts: str, key: Column, ranges: int) -> Column:
    """How many of the sorted cuts in column ``cuts`` are not above ``key``, by binary search."""

    def search(found: Column, width: int) -> Column:
        step = F.when(F.get(F.col(cuts), found + (width - 1)) <= key, found + width).otherwise(found)
        return step if width == 1 else F.get(F.transform(F.array(step), lambda now: search(now, width // 2)), F.lit(0))

    return search(F.lit(0), 1 << (max(1, ranges - 1).bit_length() - 1))


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """As :func:`global_order`, without a job or a checkpoint while the plan is made: the ranges are cut at keys that follow from
    the table itself (:func:`key_cuts`), so a lost task cuts them the same way again. ``df`` is read once for the cuts (only
    ``order``), once for the sums of the ranges and once for its rows; what it is made of must give the same rows each time.
    Rows with equal ``order`` are numbered in any order, within one range.
    """
    key = F.struct(*order)
    placed = df.withColumn("_cuts", key_cuts(df, key, ranges)).withColumn("_range", range_of("_cuts", key, ranges)).drop("_cuts")
    totals = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(*_BEFORE)  # over one row per range
    names = ["_rows", *[f"_{out}" for out in sums]]
    offsets = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names])
    inside = Window.partitionBy("_range").orderBy(*order)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumns({"_in": F.row_number().over(inside), **{f"_in_{out}": F.sum(c).over(through) for out, c in sums.items()}})
    met = counted.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))  # at most ``ranges`` rows
    return met.select(*df.columns, (F.col("_rows_before") + F.col("_in")).alias("rank"), *[(F.col(f"_{out}_before") + F.col(f"_in_{out}")).alias(out) for out in sums])


def global_order(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds ``rank`` (1-based, over the whole table) and running totals up to and including a row.

    Rows are range-partitioned on ``order`` and each range is numbered on its own; only one row
    per range meets in a single task. The ranges are checkpointed, since a re-run of the sampling
    behind them may cut differently.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(ranges, *order)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    totals = placed.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{out}") for out, c in sums.items()]
    )
    earlier = Window.orderBy("_range").rowsBetween(*_BEFORE)
    zero = F.lit(0)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_{out}").over(earlier), zero).alias(f"_{out}_before") for out in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(F.broadcast(offsets), "_range")  # one row per range: its size is the setting
        .withColumn("rank", F.col("_rows_before") + F.row_number().over(inside))
        .withColumns(
            {out: F.col(f"_{out}_before") + F.sum(c).over(through) for out, c in sums.items()}
        )
        .drop("_range", "_rows_before", *[f"_{out}_before" for out in sums])
    )
