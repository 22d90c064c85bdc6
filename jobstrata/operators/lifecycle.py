"""Posting lifecycles from a crawl log: when each posting went live, vanished and came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifecycle_spans(log: DataFrame) -> DataFrame:
    """Live spans per posting from (company_id, posting_id, day, observed).

    A day with any entry of a company counts as its crawl. A posting is live from the crawl that
    first sees it until the first crawl of its company that does not; seen again, it is revived.

    The log is reduced to one row per posting and crawl day before any window runs, so a window
    holds at most as many rows as the log has days, however hot a posting or company is.
    """
    crawls = log.groupBy("company_id", "day").agg(F.lit(1).alias("_one")).drop("_one")
    by_company = Window.partitionBy("company_id").orderBy("day")
    numbered = crawls.withColumns(
        {"crawl_no": F.row_number().over(by_company), "next_crawl": F.lead("day").over(by_company)}
    )
    seen = log.filter("observed").select("company_id", "posting_id", "day").distinct()
    by_posting = Window.partitionBy("company_id", "posting_id").orderBy("day")
    islands = seen.join(numbered, ["company_id", "day"]).withColumn(
        "island", F.col("crawl_no") - F.row_number().over(by_posting)
    )
    spans = islands.groupBy("company_id", "posting_id", "island").agg(
        F.min("day").alias("live_from"),
        F.max("day").alias("last_seen"),
        F.max_by("next_crawl", "day").alias("delisted_on"),
        F.count(F.lit(1)).alias("crawls_seen"),
    )
    in_order = Window.partitionBy("company_id", "posting_id").orderBy("live_from")
    return spans.withColumn(
        "opened_as", F.when(F.row_number().over(in_order) == 1, "new").otherwise("revived")
    ).drop("island")
