"""Counts over the index and one caller's identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.operators.predicates import active_watch, is_live


def index_status(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies, postings, live, delisted and live remote ones: one pass over the index."""
    counts = jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_live()).alias("live"),
        F.count_if(~is_live()).alias("delisted"),
        F.count_if(is_live() & (F.col("remote_policy") == "remote")).alias("live_remote"),
    )
    return counts.select(companies.agg(F.count(F.lit(1))).scalar().alias("companies"), "*")


def field_coverage(jobs: DataFrame) -> DataFrame:
    """How many live postings fill each published field, one row per field."""
    fields = ["verified_at", "source", "ghost_score", "apply_channel"]
    filled = {name: F.col(name) for name in fields} | {
        "apply_channel": F.nullif(F.col("apply_channel"), F.lit(""))
    }
    counts = jobs.filter(is_live()).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(filled[f]).alias(f) for f in fields]
    )
    pct = F.when(F.col("total") == 0, 0.0).otherwise(F.col("have") / F.col("total") * 100)
    return counts.unpivot(["total"], fields, "field", "have").select(
        "field", "have", "total", F.round(pct, 1).alias("pct")
    )


def companies_by_vendor(companies: DataFrame) -> DataFrame:
    return companies.groupBy("ats_vendor").agg(F.count(F.lit(1)).alias("companies"))


def identity_status(watches: DataFrame) -> DataFrame:
    """Active standing queries per caller."""
    return watches.filter(active_watch()).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("active_watches")
    )


def latest_receipts(receipts: DataFrame, count: int = 10) -> DataFrame:
    """A caller's last receipts, newest first."""
    return receipts.orderBy(F.desc("created_at"), F.desc("receipt_id")).limit(count)


def top_languages(shares: DataFrame, count: int = 4) -> DataFrame:
    """The largest language shares of every fingerprint."""
    order = Window.partitionBy("fingerprint").orderBy(F.desc("pct"), "language")
    return shares.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
