"""Ingest: change classes, relists, the new state, counters, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.operators import ingest
from jobstrata.operators.lifecycle import lifecycle_spans
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import query, rounded, sorted_tags, sql_sorted, sql_stamp, stamp
from jobstrata.plans.scalar_plans import facts_sql

_CHANGES = """changes AS (
  SELECT coalesce(s.id, f.id) AS id, coalesce(s.company_id, f.company_id) AS company_id,
    CASE WHEN s.id IS NULL THEN 'new' WHEN f.id IS NOT NULL AND s.content_hash = f.content_hash THEN 'unchanged'
      WHEN f.id IS NOT NULL THEN 'updated' WHEN s.delisted_at IS NULL AND c.ok THEN 'delisted' ELSE 'untouched' END AS change,
    (f.id IS NOT NULL AND s.delisted_at IS NOT NULL) AS revived
  FROM state s FULL JOIN feed f ON f.id = s.id LEFT JOIN crawls c ON c.company_id = s.company_id)"""


@query("change_classes", f"{O.INGEST}, {_CHANGES} SELECT id, company_id, change, coalesce(revived, false) AS revived FROM changes")
def change_classes(spark, sf_dir):
    classes = ingest.change_classes(X.state(spark, sf_dir), X.feed(spark, sf_dir), X.crawls(spark, sf_dir))
    return classes.select("id", "company_id", "change", "revived")


@query("delisted_ids", f"{O.INGEST}, {_CHANGES} SELECT id FROM changes WHERE change = 'delisted'")
def delisted_ids(spark, sf_dir):
    return ingest.vanished(X.state(spark, sf_dir, with_text=False), X.feed(spark, sf_dir), X.crawls(spark, sf_dir)).select("id")


@query(
    "relist_lookup",
    f"{O.INGEST} SELECT id, sibling_id, relist_count, {sql_stamp('first_seen_at')} FROM relisted",
)
def relist_lookup(spark, sf_dir):
    feed = ingest.accepted_feed(X.feed(spark, sf_dir), X.crawls(spark, sf_dir))
    found = ingest.relist_lookup(X.state(spark, sf_dir, with_text=False), feed)
    return found.select("id", "sibling_id", "relist_count", stamp("first_seen_at"))


@query(
    "ingest_stats",
    f"""{O.INGEST}, {_CHANGES}, n AS (SELECT count(*) FILTER (change = 'new') AS jobs_new, count(*) FILTER (change = 'updated') AS jobs_updated,
  count(*) FILTER (change = 'unchanged') AS jobs_unchanged, count(*) FILTER (change = 'delisted') AS jobs_delisted FROM changes)
SELECT (SELECT count(*) FROM crawls WHERE ok) AS companies_crawled, (SELECT count(*) FROM crawls WHERE NOT ok) AS companies_failed, n.*,
  (SELECT count(*) FROM relisted) AS jobs_relisted, jobs_new + jobs_updated AS extractions, jobs_new + jobs_updated + jobs_unchanged AS jobs_seen FROM n""",
)
def ingest_stats(spark, sf_dir):
    return ingest.ingest_stats(X.state(spark, sf_dir), X.feed(spark, sf_dir), X.crawls(spark, sf_dir))


@query(
    "ingest_failures",
    f"{O.POSTINGS} SELECT ats_vendor || ':' || ats_tenant AS tenant, 404 AS status, 'non-200' AS error FROM companies WHERE s_suppkey % 13 = 0",
)
def ingest_failures(spark, sf_dir):
    return ingest.failed_tenants(X.crawls(spark, sf_dir), X.companies(spark, sf_dir))


def _after(spark, sf_dir):
    return ingest.ingest(
        X.state(spark, sf_dir), X.companies(spark, sf_dir), X.feed(spark, sf_dir), X.crawls(spark, sf_dir), X.now(),
        meet_jobs=lambda rows: X.state_meets(spark, sf_dir, rows), meet_feed=lambda rows: X.feed_meets(spark, sf_dir, rows),
    )


_POSTED = "coalesce(f.posted_at, s.posted_at)"
_FIRST = f"CASE WHEN s.id IS NULL THEN coalesce(r.first_seen_at, {O.NOW}) ELSE s.first_seen_at END"
_COUNT = "CASE WHEN s.id IS NULL THEN coalesce(r.relist_count, 0) ELSE s.relist_count END"
_NEW = "(f.id IS NOT NULL AND (s.id IS NULL OR s.content_hash <> f.content_hash))"
_GONE = f"CASE WHEN f.id IS NOT NULL THEN NULL WHEN s.delisted_at IS NULL AND c.ok THEN {O.NOW} ELSE s.delisted_at END"


def _fresh(new: str, old: str) -> str:
    return f"CASE WHEN {_NEW} THEN {new} ELSE {old} END"


_AFTER = f"""facts AS ({facts_sql('feed')}), after AS (
  SELECT coalesce(s.id, f.id) AS id, coalesce(s.company_id, f.company_id) AS company_id, s.id IS NULL AS is_new, {_NEW} AS is_fresh,
    f.id IS NOT NULL AS seen, {_fresh('f.title', 's.title')} AS title, {_fresh('f.description_raw', 's.description_raw')} AS description_raw,
    {_fresh('x.f_skills', 's.skills')} AS skills, s.role_family, {_fresh('x.f_remote', 's.remote_policy')} AS remote_policy,
    {_fresh('x.f_pay.lo', 's.salary_min')} AS salary_min, {_fresh('x.f_pay.hi', 's.salary_max')} AS salary_max,
    {_fresh('x.f_pay.cur', 's.salary_currency')} AS salary_currency, {_fresh('f.location', 's.location')} AS location,
    {_POSTED} AS posted_at, coalesce(f.updated_at, s.updated_at) AS updated_at, {_FIRST} AS first_seen_at,
    CASE WHEN f.id IS NOT NULL THEN {O.NOW} ELSE s.verified_at END AS verified_at, {_GONE} AS delisted_at, {_COUNT} AS relist_count,
    coalesce(f.apply_channel, s.apply_channel) AS apply_channel, {_fresh('f.content_hash', 's.content_hash')} AS content_hash,
    coalesce(s.extraction_source, 'heuristic') AS extraction_source, coalesce(s.skills_fallback, []) AS skills_fallback,
    CASE WHEN (f.id IS NOT NULL OR c.ok) AND ({_GONE}) IS NULL
      THEN {O.ghost(_COUNT, f'coalesce({_POSTED}, {_FIRST})')} ELSE s.ghost_score END AS ghost_score
  FROM state s FULL JOIN feed f ON f.id = s.id LEFT JOIN crawls c ON c.company_id = s.company_id
  LEFT JOIN relisted r ON r.id = f.id LEFT JOIN facts x ON x.id = f.id)"""
_STATE = f"{O.INGEST}, {_AFTER}"
_ROW = f"""id, company_id, title, md5(description_raw) AS body, {sql_sorted('skills', 'skills')}, role_family, remote_policy, salary_min, salary_max,
  salary_currency, location, {sql_stamp('posted_at')}, {sql_stamp('updated_at')}, {sql_stamp('first_seen_at')}, {sql_stamp('verified_at')},
  {sql_stamp('delisted_at')}, relist_count, round(ghost_score, 6) AS ghost_score, apply_channel, content_hash, extraction_source,
  {sql_sorted('skills_fallback', 'skills_fallback')}"""


def _row(jobs):
    return jobs.select(
        "id", "company_id", "title", F.md5("description_raw").alias("body"), sorted_tags(F.col("skills"), "skills"), "role_family",
        "remote_policy", "salary_min", "salary_max", "salary_currency", "location", stamp("posted_at"), stamp("updated_at"),
        stamp("first_seen_at"), stamp("verified_at"), stamp("delisted_at"), "relist_count",
        rounded(F.col("ghost_score"), "ghost_score"), "apply_channel", "content_hash", "extraction_source",
        sorted_tags(F.col("skills_fallback"), "skills_fallback"),
    )


@query("ingest_state", f"{_STATE} SELECT {_ROW} FROM after")
def ingest_state(spark, sf_dir):
    after = _after(spark, sf_dir)
    changed = after.only("new", "updated", "unchanged", "delisted", "untouched")
    return _row(changed.drop("change").unionByName(after.untouched))


def _only(spark, sf_dir, *kinds: str):
    """The new state of the postings of one change class."""
    return _row(_after(spark, sf_dir).only(*kinds))


@query("ingest_new", f"{_STATE} SELECT {_ROW} FROM after WHERE is_new")
def ingest_new(spark, sf_dir):
    return _only(spark, sf_dir, "new")


@query("ingest_updated", f"{_STATE} SELECT {_ROW} FROM after WHERE seen AND NOT is_new")
def ingest_updated(spark, sf_dir):
    return _only(spark, sf_dir, "updated", "unchanged")


@query(
    "ingest_delisted",
    f"{_STATE}, {_CHANGES} SELECT {_ROW} FROM after WHERE id IN (SELECT id FROM changes WHERE change = 'delisted')",
)
def ingest_delisted(spark, sf_dir):
    return _only(spark, sf_dir, "delisted")


@query(
    "ingest_companies",
    f"""{O.POSTINGS} SELECT id, strftime(CASE WHEN s_suppkey % 13 <> 0 THEN {O.NOW} ELSE last_crawled_at END, '%Y-%m-%d %H:%M:%S') AS last_crawled_at
FROM companies""",
)
def ingest_companies(spark, sf_dir):
    done = ingest.stamp_crawled(X.companies(spark, sf_dir), X.crawls(spark, sf_dir), X.now())
    return done.select("id", stamp("last_crawled_at"))


# --- lifecycle ------------------------------------------------------------------------


@query(
    "lifecycle_spans",
    """WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error'),
crawl AS (SELECT DISTINCT user_id % 10 AS c, CAST(ts AS DATE) AS day FROM events),
cn AS (SELECT c, day, row_number() OVER (PARTITION BY c ORDER BY day) AS n FROM crawl),
x AS (SELECT user_id, s.day, n - row_number() OVER (PARTITION BY user_id ORDER BY s.day) AS island, n
  FROM seen s JOIN cn ON c = user_id % 10 AND cn.day = s.day),
spans AS (SELECT user_id, island, min(day) AS first_day, max(day) AS last_day, max(n) AS n, count(*) AS crawls FROM x GROUP BY 1, 2)
SELECT 'c' || user_id % 10 AS company_id, CAST(user_id AS VARCHAR) AS posting_id, CAST(first_day AS VARCHAR) AS live_from,
  CAST(last_day AS VARCHAR) AS last_seen, (SELECT CAST(cn.day AS VARCHAR) FROM cn WHERE cn.c = user_id % 10 AND cn.n = spans.n + 1) AS delisted_on,
  crawls AS crawls_seen, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY first_day) = 1 THEN 'new' ELSE 'revived' END AS opened_as
FROM spans""",
)
def spans(spark, sf_dir):
    found = lifecycle_spans(X.crawl_log(spark, sf_dir))
    return found.select(
        "company_id", "posting_id", F.col("live_from").cast("string"), F.col("last_seen").cast("string"),
        F.col("delisted_on").cast("string"), "crawls_seen", "opened_as",
    )
