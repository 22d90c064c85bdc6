"""Ranked search and company signals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions import scoring
from jobstrata.functions.remote import remote_scope
from jobstrata.functions.skills import or_empty
from jobstrata.operators import predicates as P
from jobstrata.session import as_timestamp


@dataclass(frozen=True)
class SearchParams:
    """The filters of one search; what is left at its default filters nothing."""

    skills: list[str] = field(default_factory=list)
    required_skills: list[str] = field(default_factory=list)
    remote: bool | None = None
    min_salary: int | None = None
    currency: str | None = None
    require_stated_salary: bool = False
    remote_scope: str | None = None
    role_family: str | None = None
    since: object = None

    def condition(self) -> Column:
        return P.all_of(
            P.is_live(),
            P.is_remote(self.remote),
            P.pays_at_least(self.min_salary),
            P.states_salary(self.require_stated_salary),
            P.pays_in(self.currency),
            P.first_seen_after(self.since),
            P.has_any_skill(self.skills),
            P.has_all_skills(self.required_skills),
            P.has_scope(self.remote_scope),
            P.in_family(self.role_family),
        )

    def requested(self) -> Column:
        """The skills match quality is measured against."""
        tags = self.skills or self.required_skills
        return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def ranked(jobs: DataFrame, params: SearchParams, now) -> DataFrame:
    """Matching postings with ``rank_score``; not yet sorted or cut."""
    match = scoring.match_quality(params.requested(), F.col("skills"))
    fresh = scoring.freshness(F.col("verified_at"), as_timestamp(now))
    return jobs.filter(params.condition()).withColumn("score", scoring.rank_score(match, fresh))


def posting_records(jobs: DataFrame, companies: DataFrame, requested: Column, now) -> DataFrame:
    """Postings as published records. ``requested`` may be a column of ``jobs``.

    A posting whose company is unknown shows the company id as its name.
    """
    now = as_timestamp(now)
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"))
    posted = F.coalesce("posted_at", "first_seen_at")
    scope = remote_scope(F.col("remote_policy"), F.col("location"))
    match = scoring.match_quality(requested, F.col("skills"))
    fresh = scoring.freshness(F.col("verified_at"), now)
    return jobs.join(names, "company_id", "left").select(
        *[c for c in ("watch_id", "since", "rank") if c in jobs.columns],
        F.col("id").alias("job_id"),
        "title",
        F.coalesce("_name", "company_id").alias("company"),
        "company_id",
        F.to_date(posted).alias("date_posted"),
        F.datediff(F.to_date(now), F.to_date(posted)).alias("days_open"),
        "location",
        "remote_policy",
        scope["scope"].alias("remote_scope"),
        scope["regions"].alias("eligible_regions"),
        "role_family",
        or_empty(F.col("skills")).alias("skills"),
        "salary_min",
        "salary_max",
        "salary_currency",
        "salary_inferred",
        "verified_at",
        "source",
        F.round("ghost_score", 4).alias("ghost_score"),
        "response_sla_days",
        "apply_channel",
        F.round(match, 4).alias("match_quality"),
        F.round(fresh, 4).alias("freshness"),
        F.round(scoring.rank_score(match, fresh), 6).alias("rank_score"),
    )


_RECORD_INPUT = [
    "id", "company_id", "title", "skills", "role_family", "remote_policy", "salary_min", "salary_max",
    "salary_currency", "salary_inferred", "location", "posted_at", "first_seen_at", "verified_at",
    "ghost_score", "response_sla_days", "source", "apply_channel",
]


def search_jobs(
    jobs: DataFrame, companies: DataFrame, params: SearchParams, now, limit: int = 20
) -> DataFrame:
    """The best postings by rank score, ties by id; at most 1 to 100 of them."""
    limit = max(1, min(int(limit), 100))
    best = (
        ranked(jobs, params, now)
        .orderBy(F.desc("score"), "id")
        .limit(limit)
        .select(*_RECORD_INPUT)
    )
    shown = F.array(*[F.lit(s) for s in params.skills]).cast("array<string>")
    return posting_records(best, companies, shown, now).orderBy(F.desc("rank_score"), "job_id")


def company_info(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Aggregate trust signals of every company; nothing about any individual.

    Postings are reduced to one row per company before they meet the company table.
    """
    live = (
        jobs.filter(P.is_live())
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("_live"), F.avg("ghost_score").alias("_ghost"))
    )
    return companies.join(live, companies["id"] == live["company_id"], "left").select(
        companies["id"].alias("company_id"),
        F.col("name").alias("company"),
        F.round("_ghost", 4).alias("ghost_score_avg"),
        F.coalesce("_live", F.lit(0)).cast("bigint").alias("active_jobs"),
        F.col("last_crawled_at").alias("index_built_at"),
    )


def company_lookup(requests: DataFrame, info: DataFrame) -> DataFrame:
    """Requested company ids with their signals, or an error code for an unknown id."""
    return requests.join(info, "company_id", "left").withColumn(
        "error", F.when(F.col("company").isNull(), F.lit(C.ERR_NO_COMPANY))
    )
