"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of ``links`` (a, b).

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller ones; the number of rounds
    grows with the logarithm of the longest path. Rounds are joins and aggregates over edges, cut by written tables.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = written(small.distinct(), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    tops = edges.select(F.col("v").alias("u")).distinct()
    return roots.union(tops.join(roots, "u", "left_anti").select("u", F.col("u").alias("component"))).withColumnRenamed("u", "id")
