"""Search, filters, company signals and index status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.functions import scoring
from jobstrata.functions.remote import remote_scope
from jobstrata.operators import ingest, predicates as P, search, status
from jobstrata.operators.search import SearchParams
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import joined, query, rounded, sorted_tags, sql_sorted, sql_stamp, sql_tags, stamp

_SCORE = f"(0.7::DOUBLE * mq + 0.3::DOUBLE * {O.fresh('verified_at')})"
FLAGSHIP = SearchParams(skills=["Rust", "k8s"], remote=True, min_salary=200_000)
_FLAGSHIP_WHERE = """delisted_at IS NULL AND remote_policy = 'remote'
  AND (salary_max >= 200000 OR salary_min >= 200000 OR (salary_min IS NULL AND salary_max IS NULL))
  AND list_has_any(skills, ['rust','k8s'])"""
_MQ = "len(list_intersect(['rust','k8s'], skills)) / 2.0::DOUBLE"


def scope_sql(location: str = "location", policy: str = "remote_policy") -> tuple[str, str]:
    """Scope and sorted labels of a posting in DuckDB."""
    place = f"lower(coalesce({location}, ''))"

    def labels(pairs: list[tuple[str, str]]) -> str:
        items = ", ".join(f"CASE WHEN contains({place}, '{t}') THEN '{n}' END" for t, n in pairs)
        return f"list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL)))"

    regions = labels([
        ("emea", "EMEA"), ("apac", "APAC"), ("americas", "Americas"), ("latam", "LATAM"), ("europe", "Europe"),
        ("north america", "North America"), ("asia", "Asia"), ("eu", "EU"), ("ap", "APAC"),
    ])
    countries = labels([
        ("united states", "US"), ("usa", "US"), ("u.s.", "US"), ("us-", "US"), ("us ", "US"),
        ("united kingdom", "UK"), ("uk", "UK"), ("canada", "Canada"), ("germany", "Germany"), ("india", "India"),
        ("france", "France"), ("ireland", "Ireland"), ("australia", "Australia"), ("spain", "Spain"),
        ("poland", "Poland"), ("netherlands", "Netherlands"), ("brazil", "Brazil"), ("singapore", "Singapore"),
        ("japan", "Japan"), ("israel", "Israel"), ("mexico", "Mexico"),
    ])
    anywhere = (
        f"({place} = '' OR contains({place}, 'worldwide') OR contains({place}, 'global') OR contains({place}, 'anywhere')"
        f" OR contains({place}, 'any location') OR trim({place}) IN ('remote', 'fully remote'))"
    )
    scope = (
        f"CASE WHEN {policy} IS DISTINCT FROM 'remote' THEN NULL WHEN {anywhere} THEN 'worldwide'"
        f" WHEN len({regions}) > 0 THEN 'region_locked' WHEN len({countries}) > 0 THEN 'country_locked' ELSE 'worldwide' END"
    )
    both = (
        f"CASE WHEN {policy} IS DISTINCT FROM 'remote' OR {anywhere} THEN [] WHEN len({regions}) > 0 THEN {regions}"
        f" ELSE {countries} END"
    )
    return scope, both


_SCOPE, _REGIONS = scope_sql()


def _flat(records: DataFrame) -> DataFrame:
    """A posting record with printable columns."""
    return records.select(
        *[c for c in ("watch_id",) if c in records.columns],
        "job_id", "title", "company", "company_id",
        F.col("date_posted").cast("string").alias("date_posted"),
        F.col("days_open").cast("bigint").alias("days_open"),
        "location", "remote_policy", "remote_scope",
        joined(F.col("eligible_regions"), "eligible_regions"),
        "role_family", sorted_tags(F.col("skills"), "skills"),
        "salary_min", "salary_max", "salary_currency", stamp("verified_at"), "source",
        "ghost_score", "response_sla_days", "apply_channel", "match_quality", "freshness", "rank_score",
    )


def record_sql(source: str, extra: str = "") -> str:
    """The columns of :func:`_flat` over rows that carry ``mq``."""
    return f"""SELECT {extra} j.id AS job_id, title, coalesce(c.name, company_id) AS company, company_id,
  CAST(CAST(coalesce(posted_at, first_seen_at) AS DATE) AS VARCHAR) AS date_posted,
  date_diff('day', CAST(coalesce(posted_at, first_seen_at) AS DATE), CAST({O.NOW} AS DATE)) AS days_open,
  location, remote_policy, {_SCOPE} AS remote_scope, {sql_tags(_REGIONS, 'eligible_regions')}, role_family,
  {sql_sorted('skills', 'skills')}, salary_min, salary_max, salary_currency, {sql_stamp('verified_at')}, source,
  round(ghost_score, 4) AS ghost_score, response_sla_days, apply_channel, round(mq, 4) AS match_quality,
  round({O.fresh('verified_at')}, 4) AS freshness, round({_SCORE}, 6) AS rank_score
FROM ({source}) j LEFT JOIN companies c ON c.id = j.company_id"""


@query(
    "search_jobs",
    f"{O.JOBS} " + record_sql(
        f"SELECT * FROM (SELECT *, {_MQ} AS mq FROM jobs WHERE {_FLAGSHIP_WHERE}) ORDER BY {_SCORE} DESC, id LIMIT 20"
    ),
)
def search_jobs(spark, sf_dir):
    return _flat(search.search_jobs(X.jobs(spark, sf_dir), X.companies(spark, sf_dir), FLAGSHIP, X.now()))


@query(
    "search_with_company",
    f"{O.JOBS} SELECT j.id AS job_id, coalesce(c.name, company_id) AS company, round({_SCORE}, 6) AS score "
    f"FROM (SELECT *, {_MQ} AS mq FROM jobs WHERE {_FLAGSHIP_WHERE}) j LEFT JOIN companies c ON c.id = j.company_id",
)
def search_with_company(spark, sf_dir):
    hits = search.ranked(X.jobs(spark, sf_dir), FLAGSHIP, X.now())
    names = X.companies(spark, sf_dir).select(F.col("id").alias("company_id"), "name")
    return hits.join(names, "company_id", "left").select(
        F.col("id").alias("job_id"), F.coalesce("name", "company_id").alias("company"), rounded(F.col("score"), "score")
    )


@query("posting_projection", f"{O.JOBS} " + record_sql("SELECT *, 1.0::DOUBLE AS mq FROM jobs"))
def posting_projection(spark, sf_dir):
    none = F.array().cast("array<string>")
    return _flat(search.posting_records(X.jobs(spark, sf_dir), X.companies(spark, sf_dir), none, X.now()))


def _filter_query(name: str, params: SearchParams, where: str) -> None:
    """One hard filter on its own over all live postings."""

    @query(name, f"{O.JOBS} SELECT id FROM jobs WHERE delisted_at IS NULL AND {where}")
    def run(spark, sf_dir):
        return X.jobs(spark, sf_dir).filter(params.condition()).select("id")


_filter_query("filter_live", SearchParams(), "true")
_filter_query("filter_remote", SearchParams(remote=True), "remote_policy = 'remote'")
_filter_query(
    "filter_min_salary", SearchParams(min_salary=300_000),
    "(salary_max >= 300000 OR salary_min >= 300000 OR (salary_min IS NULL AND salary_max IS NULL))",
)
_filter_query(
    "filter_stated_salary", SearchParams(require_stated_salary=True),
    "(salary_min IS NOT NULL OR salary_max IS NOT NULL)",
)
_filter_query("filter_currency", SearchParams(currency="eur"), "salary_currency = 'EUR'")
_filter_query("filter_since", SearchParams(since="1999-06-01 00:00:00"), "first_seen_at > TIMESTAMP '1999-06-01'")
_filter_query("filter_skills_any", SearchParams(skills=["RUST", "cuda"]), "list_has_any(skills, ['rust','cuda'])")
_filter_query(
    "filter_skills_all", SearchParams(required_skills=["Go", "sql"]), "list_has_all(skills, ['go','sql'])"
)
_filter_query("filter_remote_scope", SearchParams(remote_scope="region_locked"), f"({_SCOPE}) = 'region_locked'")
_filter_query("filter_role_family", SearchParams(role_family="Engineering"), "role_family = 'engineering'")


@query(
    "remote_scope",
    f"{O.JOBS} SELECT id, {_SCOPE} AS scope, {sql_tags(_REGIONS, 'regions')} FROM jobs",
)
def remote_scopes(spark, sf_dir):
    scope = remote_scope(F.col("remote_policy"), F.col("location"))
    return X.jobs(spark, sf_dir).select("id", scope["scope"].alias("scope"), joined(scope["regions"], "regions"))


@query(
    "match_quality",
    f"{O.JOBS} SELECT id, round(len(list_intersect(['python','sql','llm'], skills)) / 3.0::DOUBLE, 6) AS match_quality FROM jobs",
)
def match_qualities(spark, sf_dir):
    wanted = F.array(*[F.lit(s) for s in ("Python", "SQL", "llm")])
    return X.jobs(spark, sf_dir).select("id", rounded(scoring.match_quality(wanted, F.col("skills")), "match_quality"))


@query("freshness", f"{O.JOBS} SELECT id, round({O.fresh('verified_at')}, 6) AS freshness FROM jobs")
def freshnesses(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("id", rounded(scoring.freshness(F.col("verified_at"), X.now()), "freshness"))


@query(
    "rank_score",
    f"{O.JOBS} SELECT id, round({_SCORE}, 6) AS rank_score FROM (SELECT *, {_MQ} AS mq FROM jobs)",
)
def rank_scores(spark, sf_dir):
    match = scoring.match_quality(F.array(F.lit("rust"), F.lit("k8s")), F.col("skills"))
    score = scoring.rank_score(match, scoring.freshness(F.col("verified_at"), X.now()))
    return X.jobs(spark, sf_dir).select("id", rounded(score, "rank_score"))


@query("ghost_score", f"{O.JOBS} SELECT id, round(ghost_score, 6) AS ghost_score FROM jobs")
def ghost_scores(spark, sf_dir):
    scored = ingest.recompute_ghost(
        X.jobs(spark, sf_dir).withColumns({"delisted_at": F.lit(None).cast("timestamp"), "ghost_score": F.lit(0.0)}),
        X.now(),
    )
    return scored.select("id", rounded(F.col("ghost_score"), "ghost_score"))


@query(
    "ghost_recompute",
    f"{O.JOBS} SELECT id, round(CASE WHEN delisted_at IS NULL THEN "
    f"{O.ghost('relist_count', 'coalesce(posted_at, first_seen_at)', 'TIMESTAMP ' + chr(39) + '2001-10-01' + chr(39))}"
    " ELSE ghost_score END, 6) AS ghost_score FROM jobs",
)
def ghost_recompute(spark, sf_dir):
    scored = ingest.recompute_ghost(X.jobs(spark, sf_dir), "2001-10-01 00:00:00")
    return scored.select("id", rounded(F.col("ghost_score"), "ghost_score"))


# --- company signals and status ------------------------------------------------


@query(
    "company_info",
    f"""{O.JOBS} SELECT c.id AS company_id, c.name AS company, round(avg(j.ghost_score), 4) AS ghost_score_avg,
  count(j.id) AS active_jobs, {sql_stamp('last_crawled_at', 'index_built_at')}
FROM companies c LEFT JOIN jobs j ON j.company_id = c.id AND j.delisted_at IS NULL GROUP BY c.id, c.name, last_crawled_at""",
)
def company_info(spark, sf_dir):
    info = search.company_info(X.jobs(spark, sf_dir), X.companies(spark, sf_dir))
    return info.select("company_id", "company", "ghost_score_avg", "active_jobs", stamp("index_built_at"))


@query(
    "company_lookup",
    f"""{O.JOBS} SELECT DISTINCT 'c' || c_nationkey * 7 AS company_id, c.name AS company,
  CASE WHEN c.id IS NULL THEN 'ERR_COMPANY_NOT_FOUND' END AS error
FROM customer LEFT JOIN companies c ON c.id = 'c' || c_nationkey * 7""",
)
def company_lookup(spark, sf_dir):
    asked = X.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey") * 7).alias("company_id")
    )
    info = search.company_info(X.jobs(spark, sf_dir), X.companies(spark, sf_dir))
    return search.company_lookup(asked.distinct(), info).select("company_id", "company", "error")


@query(
    "index_status",
    f"""{O.JOBS} SELECT (SELECT count(*) FROM companies) AS companies, count(*) AS total,
  count(*) FILTER (delisted_at IS NULL) AS live, count(*) FILTER (delisted_at IS NOT NULL) AS delisted,
  count(*) FILTER (delisted_at IS NULL AND remote_policy = 'remote') AS live_remote FROM jobs""",
)
def index_status(spark, sf_dir):
    return status.index_status(X.jobs(spark, sf_dir), X.companies(spark, sf_dir))


@query(
    "field_coverage",
    f"""{O.JOBS}, live AS (SELECT * FROM jobs WHERE delisted_at IS NULL),
c AS (SELECT 'verified_at' AS field, count(verified_at) AS have, count(*) AS total FROM live
  UNION ALL SELECT 'source', count(source), count(*) FROM live
  UNION ALL SELECT 'ghost_score', count(ghost_score), count(*) FROM live
  UNION ALL SELECT 'apply_channel', count(nullif(apply_channel, '')), count(*) FROM live)
SELECT field, have, total, round(CASE WHEN total = 0 THEN 0 ELSE have / total * 100.0::DOUBLE END, 1) AS pct FROM c""",
)
def field_coverage(spark, sf_dir):
    return status.field_coverage(X.jobs(spark, sf_dir))


@query(
    "companies_by_vendor",
    f"{O.JOBS} SELECT ats_vendor, count(*) AS companies FROM companies GROUP BY 1",
)
def companies_by_vendor(spark, sf_dir):
    return status.companies_by_vendor(X.companies(spark, sf_dir))


@query(
    "hot_companies",
    f"{O.JOBS} SELECT DISTINCT company_id FROM jobs WHERE first_seen_at >= {O.NOW} - to_days(7) OR delisted_at >= {O.NOW} - to_days(7)",
)
def hot_companies(spark, sf_dir):
    return ingest.hot_companies(X.jobs(spark, sf_dir), X.now())


_DUE = f"""hot AS (SELECT DISTINCT company_id FROM jobs WHERE first_seen_at >= {O.NOW} - to_days(7) OR delisted_at >= {O.NOW} - to_days(7)),
due AS (SELECT * FROM companies WHERE last_crawled_at IS NULL OR ({O.NOW} - last_crawled_at >= to_minutes(30)
  AND {O.NOW} - last_crawled_at >= CASE WHEN id IN (SELECT company_id FROM hot) THEN to_hours(6) ELSE to_hours(24) END))"""


@query("due_companies", f"{O.JOBS}, {_DUE} SELECT id, {sql_stamp('last_crawled_at')} FROM due")
def due_companies(spark, sf_dir):
    due = ingest.due_companies(X.companies(spark, sf_dir), X.jobs(spark, sf_dir), X.now())
    return due.select("id", stamp("last_crawled_at"))


@query(
    "crawl_plan",
    f"""{O.JOBS}, {_DUE}, wanted AS (SELECT DISTINCT 'c' || c_nationkey AS id FROM customer)
SELECT 'wanted' AS plan, id FROM companies WHERE id IN (SELECT id FROM wanted)
UNION ALL SELECT 'due', id FROM due UNION ALL SELECT 'all', id FROM companies""",
)
def crawl_plan(spark, sf_dir):
    companies, jobs = X.companies(spark, sf_dir), X.jobs(spark, sf_dir)
    wanted = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("id"))
    plans = {
        "wanted": ingest.crawl_plan(companies, jobs, X.now(), wanted=wanted),
        "due": ingest.crawl_plan(companies, jobs, X.now()),
        "all": ingest.crawl_plan(companies, jobs, X.now(), respect_interval=False),
    }
    rows = [df.select(F.lit(name).alias("plan"), "id") for name, df in plans.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
