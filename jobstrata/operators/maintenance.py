"""Repairs of the index: posting dates, application links, late columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions import scoring
from jobstrata.functions.urls import ats_job_id, resolve_apply
from jobstrata.operators.ingest import accepted_feed
from jobstrata.session import as_timestamp


def _dated(jobs: DataFrame, feed: DataFrame, crawls: DataFrame) -> DataFrame:
    """Postings with the fresh dates of their last feed copy and how they matched."""
    last = F.max_by(F.struct("posted_at", "updated_at"), "feed_pos")
    fresh = accepted_feed(feed, crawls).groupBy("id").agg(last.alias("_fresh"))
    valid = crawls.filter("ok").select("company_id", F.lit(True).alias("_crawled")).distinct()
    joined = jobs.join(valid, "company_id", "left").join(fresh, "id", "left")
    match = (
        F.when(F.col("_crawled").isNull(), F.lit(None))
        .when(F.col("_fresh").isNull(), F.lit("unmatched"))
        .when(F.col("_fresh.posted_at").isNull(), F.lit("undated"))
        .otherwise(F.lit("dated"))
    )
    return joined.withColumn("_match", match)


def backfill_dates(jobs: DataFrame, feed: DataFrame, crawls: DataFrame, now) -> DataFrame:
    """The employer's dates written onto matching postings, then the staleness of the live ones."""
    dated = F.coalesce(F.col("_match") == "dated", F.lit(False))
    live = F.col("_crawled").isNotNull() & F.col("delisted_at").isNull()
    moved = _dated(jobs, feed, crawls).withColumns(
        {
            "posted_at": F.when(dated, F.col("_fresh.posted_at")).otherwise(F.col("posted_at")),
            "updated_at": F.when(dated, F.col("_fresh.updated_at")).otherwise(F.col("updated_at")),
        }
    )
    score = scoring.ghost_score_at(
        F.col("relist_count"), F.col("posted_at"), F.col("first_seen_at"), as_timestamp(now)
    )
    return moved.withColumn("ghost_score", F.when(live, score).otherwise(F.col("ghost_score"))).select(
        jobs.columns
    )


def backfill_stats(jobs: DataFrame, feed: DataFrame, crawls: DataFrame) -> DataFrame:
    rows = _dated(jobs, feed, crawls).agg(
        F.count_if(F.col("_match") == "dated").alias("jobs_dated"),
        F.count_if(F.col("_match") == "undated").alias("jobs_no_ats_date"),
        F.count_if(F.col("_match") == "unmatched").alias("jobs_unmatched"),
        F.count_if(F.col("_match").isNotNull() & F.col("delisted_at").isNull()).alias("ghost_recomputed"),
    )
    companies = crawls.agg(F.struct(
        F.count_if("ok").alias("companies_fetched"), F.count_if(~F.col("ok")).alias("companies_failed")
    ).alias("all"))
    return rows.withColumn("_companies", companies.scalar()).select(*rows.columns, "_companies.*")


def _resolved(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    tenants = companies.select(F.col("id").alias("company_id"), "ats_vendor", "ats_tenant")
    resolution = resolve_apply(
        F.col("ats_vendor"), F.col("ats_tenant"), ats_job_id(F.col("id")), F.col("apply_channel")
    )
    return jobs.join(tenants, "company_id", "left").withColumn(
        "_apply", F.when(F.col("ats_vendor").isNotNull(), resolution)
    )


def regenerate_apply_channels(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Every link resolved again from what is stored; postings without a company keep theirs."""
    return (
        _resolved(jobs, companies)
        .withColumn("apply_channel", F.coalesce("_apply.url", "apply_channel"))
        .select(jobs.columns)
    )


def regeneration_stats(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return _resolved(jobs, companies).agg(
        F.count(F.lit(1)).alias("jobs_total"),
        F.count_if(F.col("_apply.url") != F.col("apply_channel")).alias("jobs_rewritten"),
        F.count_if("_apply.used_fallback").alias("jobs_fallback"),
        F.count_if("_apply.is_embed").alias("embed_jobs"),
    )


def embed_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies whose stored links lead to their own embedding pages, with how many do."""
    return (
        _resolved(jobs, companies)
        .filter("_apply.is_embed")
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("embed_jobs"))
    )


def add_missing_columns(jobs: DataFrame) -> tuple[DataFrame, list[str]]:
    """An index of an earlier release brought to today's columns, and which ones were added.

    The extraction source of existing rows is the heuristic, but only when that column is new.
    """
    kinds = {f.name: f.dataType for f in schemas.JOBS.fields}
    added = [name for name in schemas.LATE_JOB_COLUMNS if name not in jobs.columns]
    defaults = {name: F.lit(None).cast(kinds[name]) for name in added}
    if "extraction_source" in added:
        defaults["extraction_source"] = F.lit(C.HEURISTIC_SOURCE)
    return (jobs.withColumns(defaults) if added else jobs), added
