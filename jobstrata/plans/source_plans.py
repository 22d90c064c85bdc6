"""Payload parsing and seeding."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.operators import seed
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import query, sql_stamp, stamp
from jobstrata.sources import landing

# What parsing the payloads must give back, from the projection alone.
_PUBLISHED = f"""pub AS (
  SELECT d.* EXCLUDE (description_raw, salary_min, salary_max, salary_currency, updated_at),
    description_raw || CASE WHEN k % 5 = 0 THEN ' Updated.' ELSE '' END AS body,
    salary_min AS smin, salary_max AS smax, salary_currency AS scur,
    d.updated_at AS upd, {O.resolved('vendor', 'tenant', 'ats_job_id', 'vendor_url')} AS apply_channel,
    coalesce(workplace, CASE WHEN contains(lower(coalesce(location, '')), 'remote') THEN 'remote' END, 'unknown') AS remote_hint
  FROM described d WHERE in_feed AND company_no % 13 <> 0 AND NOT (vendor = 'ashby' AND k % 3 <> 0 AND k % 11 = 0)),
expected AS (
  SELECT id, vendor, company_id, k, ats_job_id, title, apply_channel, location, remote_hint, posted_at, upd AS updated_at,
    CASE WHEN vendor = 'lever' OR (vendor = 'ashby' AND k % 2 = 0)
      THEN regexp_replace(regexp_replace(body, '^{O.SPACE}+', ''), '{O.SPACE}+$', '')
      ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
           '^{O.SPACE}+', ''), '{O.SPACE}+$', '') END AS description_raw,
    CASE WHEN vendor = 'lever' AND k % 16 = 2 THEN NULL WHEN vendor <> 'greenhouse' THEN smin END AS salary_min,
    CASE WHEN vendor = 'lever' AND k % 16 = 2 THEN NULL WHEN vendor <> 'greenhouse' THEN smax END AS salary_max,
    CASE WHEN vendor <> 'greenhouse' THEN scur END AS salary_currency
  FROM pub)"""
_EXPECTED = f"{O.DESCRIBED}, {_PUBLISHED}"
_COLUMNS = (
    "company_id, ats_job_id, title, md5(description_raw) AS body, apply_channel, location, remote_hint, salary_min, salary_max, "
    f"salary_currency, {sql_stamp('posted_at')}, {sql_stamp('updated_at')}"
)


def _shown(feed):
    return feed.select(
        "company_id", "ats_job_id", "title", F.md5("description_raw").alias("body"), "apply_channel", "location", "remote_hint",
        "salary_min", "salary_max", "salary_currency", stamp("posted_at"), stamp("updated_at"),
    )


_PARSERS = {
    "greenhouse": landing.parse_greenhouse,
    "lever": landing.parse_lever,
    "ashby": landing.parse_ashby,
}


def _vendor_queries(vendor: str, parse) -> None:
    where = f"FROM expected WHERE vendor = '{vendor}'"

    @query(f"parse_{vendor}", f"{_EXPECTED} SELECT {_COLUMNS} {where}")
    def parsed(spark, sf_dir):
        return _shown(parse(X.landing(spark, sf_dir, vendor)))

    @query(f"remote_hint_{vendor}", f"{_EXPECTED} SELECT id, remote_hint {where}")
    def hints(spark, sf_dir):
        feed = parse(X.landing(spark, sf_dir, vendor))
        return feed.select(F.concat_ws(":", "company_id", "ats_job_id").alias("id"), "remote_hint")

    if vendor != "greenhouse":

        @query(f"salary_{vendor}", f"{_EXPECTED} SELECT id, salary_min, salary_max, salary_currency {where}")
        def salaries(spark, sf_dir):
            feed = parse(X.landing(spark, sf_dir, vendor))
            return feed.select(
                F.concat_ws(":", "company_id", "ats_job_id").alias("id"), "salary_min", "salary_max", "salary_currency"
            )


for _vendor, _parse in _PARSERS.items():
    _vendor_queries(_vendor, _parse)


@query("feed_union", f"{_EXPECTED} SELECT {_COLUMNS} FROM expected")
def feed_union(spark, sf_dir):
    return _shown(landing.feed_of(X.landing(spark, sf_dir)))


# Failures by kind, in the order of the fixture.
_FAILURES = """failures AS (SELECT 'c' || s_suppkey AS company_id, 't' || s_suppkey AS tenant, (s_suppkey // 13) % 6 AS kind,
  (['greenhouse','lever','ashby'])[s_suppkey % 3 + 1] AS vendor FROM supplier WHERE s_suppkey % 13 = 0),
failed AS (SELECT company_id, tenant, kind, CASE kind WHEN 4 THEN 'workday' WHEN 5 THEN 'greenhouse' ELSE vendor END AS vendor,
  CAST(([404,200,200,0,200,200])[kind + 1] AS INTEGER) AS status,
  (['non-200','non-json body','no jobs array','ConnectTimeout: timed out','unknown vendor','parse error'])[kind + 1] AS error FROM failures)"""


@query(
    "payload_validate",
    f"""{O.POSTINGS}, {_FAILURES} SELECT company_id, vendor, false AS ok, status, error, 0 AS jobs FROM failed
UNION ALL SELECT company_id, vendor, true, 200, NULL, count(*) FROM postings WHERE in_feed AND company_no % 13 <> 0 GROUP BY 1, 2""",
)
def payload_validate(spark, sf_dir):
    results = landing.crawl_results(X.landing(spark, sf_dir))
    return results.select("company_id", "vendor", "ok", "status", "error", "jobs")


@query("feed_rejects", f"{O.POSTINGS}, {_FAILURES} SELECT company_id, vendor, tenant, status, error FROM failed")
def feed_rejects(spark, sf_dir):
    return landing.rejects(X.landing(spark, sf_dir)).select("company_id", "vendor", "tenant", "status", "error")


# --- seeding ------------------------------------------------------------------------


def _seed_input(spark, sf_dir):
    """Suppliers as candidate tenants; the ones with a non-negative balance are known already.

    A tenant is its own company id here, and the crawl tells how many postings it has.
    """
    known = X.companies(spark, sf_dir).join(
        X.table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("c"), "s_suppkey").alias("id")),
        "id", "left_semi",
    )
    candidates = X.companies(spark, sf_dir).select(
        F.concat("name", F.lit(" Inc")).alias("name"), F.col("ats_vendor").alias("vendor"), F.col("id").alias("tenant")
    )
    counts = X.postings(spark, sf_dir).filter("in_feed").groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs"))
    crawls = X.crawls(spark, sf_dir).join(counts, "company_id", "left")
    return known, candidates, crawls


_SEED = f"""{O.POSTINGS}, known AS (SELECT * FROM companies WHERE s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)),
cand AS (SELECT c.id AS tenant, c.name || ' Inc' AS name, ats_vendor AS vendor, (s_suppkey % 13 <> 0 AND coalesce(n, 0) > 0) AS valid, coalesce(n, 0) AS n
  FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM postings WHERE in_feed GROUP BY 1) p ON p.company_id = c.id)"""


@query(
    "seed_upsert",
    f"""{_SEED} SELECT coalesce(k.id, c.tenant) AS id, CASE WHEN c.tenant IS NOT NULL THEN c.name ELSE k.name END AS name,
  coalesce(c.vendor, k.ats_vendor) AS ats_vendor, CASE WHEN k.id IS NULL THEN c.tenant ELSE k.ats_tenant END AS ats_tenant,
  CASE WHEN c.tenant IS NOT NULL THEN {O.careers('c.vendor', 'c.tenant')} ELSE k.careers_url END AS careers_url, false AS verified,
  {sql_stamp('k.last_crawled_at', 'last_crawled_at')} FROM known k FULL JOIN (SELECT * FROM cand WHERE valid) c ON c.tenant = k.id""",
)
def seed_upsert(spark, sf_dir):
    result = seed.seed_upsert(*_seed_input(spark, sf_dir))
    return result.select("id", "name", "ats_vendor", "ats_tenant", "careers_url", "verified", stamp("last_crawled_at"))


@query(
    "seed_stats",
    f"""{_SEED} SELECT count(*) FILTER (valid) AS verified, count(*) FILTER (NOT valid) AS rejected,
  count(*) FILTER (valid AND tenant NOT IN (SELECT id FROM known)) AS inserted, CAST(sum(CASE WHEN valid THEN n ELSE 0 END) AS BIGINT) AS total_jobs FROM cand""",
)
def seed_stats(spark, sf_dir):
    return seed.seed_stats(*_seed_input(spark, sf_dir))


@query("seed_rejected", f"{_SEED} SELECT vendor || ':' || tenant AS tenant FROM cand WHERE NOT valid")
def seed_rejected(spark, sf_dir):
    _, candidates, crawls = _seed_input(spark, sf_dir)
    return seed.rejected_tenants(candidates, crawls)
