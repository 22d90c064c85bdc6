"""Model rebuild, repairs and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.operators import maintenance, predicates, rebuild
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import query, rounded, sorted_tags, sql_sorted, sql_stamp, stamp
from jobstrata.sources.snapshot import snapshot_stats

_W = "(['python','rust','go','k8s','sql','aws','llm','rag','cuda','java'])"
_OUTCOMES = f"""outcomes AS (SELECT id AS job_id, k, k % 17 <> 0 AS ok,
    CASE WHEN k % 17 <> 0 THEN list_distinct([{_W}[(k + 1) % 10 + 1], {_W}[(k + 3) % 10 + 1]]) ELSE [] END AS o_skills,
    CASE WHEN k % 17 <> 0 THEN 'hybrid' ELSE 'unknown' END AS o_remote, CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN 1 END AS o_min,
    CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN 2 END AS o_max, CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN 'EUR' END AS o_cur,
    CASE WHEN k % 17 <> 0 THEN 500 + k % 900 ELSE 0 END AS tin, CASE WHEN k % 17 <> 0 THEN 20 + k % 60 ELSE 0 END AS tout FROM postings),
joined AS (SELECT j.*, o.* EXCLUDE (k, job_id), (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS paid FROM jobs j JOIN outcomes o ON o.job_id = j.id),
merged AS (SELECT *, CASE WHEN coalesce(remote_policy, '') IN ('', 'unknown') THEN o_remote ELSE remote_policy END AS m_remote,
    CASE WHEN paid THEN salary_min ELSE o_min END AS m_min, CASE WHEN paid THEN salary_max ELSE o_max END AS m_max,
    CASE WHEN paid THEN salary_currency ELSE o_cur END AS m_cur FROM joined)"""
_REBUILD = f"{O.JOBS}, {_OUTCOMES}"
_BATCH, _CEILING, _LIMIT = 50, 6.0, 9000


def _cost(tokens_in: str, tokens_out: str) -> str:
    return f"({tokens_in} / 1000000.0::DOUBLE * 2.0::DOUBLE + {tokens_out} / 1000000.0::DOUBLE * 8.0::DOUBLE)"


def _plan_sql(pending: str, ceiling: float, limit: int | None, batch: int) -> str:
    cut = "" if limit is None else f"WHERE r <= {limit}"
    return f"""ranked AS (SELECT id, ok, tin, tout, row_number() OVER (ORDER BY id) AS r FROM merged WHERE {pending}),
run AS (SELECT *, (r - 1) // {batch} AS batch FROM ranked {cut}),
batches AS (SELECT batch, {_cost('sum(sum(tin)) OVER (ORDER BY batch)', 'sum(sum(tout)) OVER (ORDER BY batch)')} AS upto FROM run GROUP BY batch),
stop AS (SELECT min(batch) AS b FROM batches WHERE upto >= {ceiling}),
plan AS (SELECT *, batch <= coalesce((SELECT b FROM stop), batch) AS done FROM run)"""


_PENDING = "extraction_source <> 'model'"
_PLANNED = f"{_REBUILD}, {_plan_sql(_PENDING, _CEILING, _LIMIT, _BATCH)}"


@query("pending_extraction", f"{O.JOBS} SELECT id, {_PENDING} AS extraction, role_family IS NULL AS family FROM jobs")
def pending_extraction(spark, sf_dir):
    return X.jobs(spark, sf_dir).select(
        "id", predicates.pending_extraction(C.TARGET_SOURCE).alias("extraction"), predicates.pending_family().alias("family")
    )


@query("cost_ceiling", f"{_PLANNED} SELECT id, r AS rank, batch, done FROM plan")
def cost_ceiling(spark, sf_dir):
    plan = rebuild.cost_ceiling(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir), _BATCH, _LIMIT, _CEILING)
    return plan.select("id", "rank", "batch", "done")


def _values(df):
    return df.select("id", sorted_tags(F.col("skills"), "skills"), "remote_policy", "salary_min", "salary_max", "salary_currency")


# Outcomes follow from the posting's number, so the twin needs no join of the index with itself.
_OWN_OUTCOME = f"""{O.JOBS}, outcome AS (SELECT *, list_sort(list_distinct([{_W}[(k + 1) % 10 + 1], {_W}[(k + 3) % 10 + 1]])) AS said,
  salary_min IS NOT NULL OR salary_max IS NOT NULL AS paid FROM jobs WHERE k % 17 <> 0)"""


@query(
    "merge_extraction",
    f"""{_OWN_OUTCOME} SELECT id, array_to_string(said, ',') AS skills, CASE WHEN coalesce(remote_policy, '') IN ('', 'unknown') THEN 'hybrid' ELSE remote_policy END AS remote_policy,
  CASE WHEN paid THEN salary_min WHEN k % 2 = 0 THEN 1 END AS salary_min, CASE WHEN paid THEN salary_max WHEN k % 2 = 0 THEN 2 END AS salary_max,
  CASE WHEN paid THEN salary_currency WHEN k % 2 = 0 THEN 'EUR' END AS salary_currency FROM outcome""",
)
def merge_extraction(spark, sf_dir):
    return _values(rebuild.merged_values(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir)))


_FALLBACK = """CASE WHEN extraction_source <> 'model' THEN skills ELSE skills_fallback END AS skills_fb,
  CASE WHEN extraction_source <> 'model' THEN remote_policy ELSE remote_policy_fallback END AS remote_fb,
  CASE WHEN extraction_source <> 'model' THEN salary_min ELSE salary_min_fallback END AS min_fb"""


def _fallbacks(df):
    return df.select(
        "id", sorted_tags(F.col("skills_fallback"), "skills_fb"), F.col("remote_policy_fallback").alias("remote_fb"),
        F.col("salary_min_fallback").alias("min_fb"),
    )


@query(
    "fallback_copy",
    f"{O.JOBS}, f AS (SELECT id, {_FALLBACK} FROM jobs) SELECT id, {sql_sorted('skills_fb', 'skills_fb')}, remote_fb, min_fb FROM f",
)
def fallback_copy(spark, sf_dir):
    return _fallbacks(rebuild.keep_fallback(X.jobs(spark, sf_dir)))


@query(
    "rollback_extraction",
    f"""{O.JOBS}, b AS (SELECT id, CASE WHEN extraction_source = 'model' THEN skills_fallback ELSE skills END AS s,
  CASE WHEN extraction_source = 'model' THEN remote_policy_fallback ELSE remote_policy END AS remote_policy,
  CASE WHEN extraction_source = 'model' THEN salary_min_fallback ELSE salary_min END AS salary_min,
  CASE WHEN extraction_source = 'model' THEN salary_max_fallback ELSE salary_max END AS salary_max,
  CASE WHEN extraction_source = 'model' THEN salary_currency_fallback ELSE salary_currency END AS salary_currency FROM jobs)
SELECT id, array_to_string(s, ',') AS skills, remote_policy, salary_min, salary_max, salary_currency, 'heuristic' AS extraction_source FROM b""",
)
def rollback_extraction(spark, sf_dir):
    back = rebuild.rollback_extraction(X.jobs(spark, sf_dir))
    return back.select(
        "id", F.array_join("skills", ",").alias("skills"), "remote_policy", "salary_min", "salary_max", "salary_currency", "extraction_source"
    )


@query(
    "rebuild_extraction",
    f"""{_PLANNED}, hit AS (SELECT m.*, coalesce(p.done AND p.ok, false) AS hit FROM merged m LEFT JOIN plan p USING (id))
SELECT id, array_to_string(list_sort(CASE WHEN hit THEN o_skills ELSE skills END), ',') AS skills,
  CASE WHEN hit THEN m_remote ELSE remote_policy END AS remote_policy, CASE WHEN hit THEN m_min ELSE salary_min END AS salary_min,
  CASE WHEN hit THEN m_max ELSE salary_max END AS salary_max, CASE WHEN hit THEN m_cur ELSE salary_currency END AS salary_currency,
  CASE WHEN hit THEN 'model' ELSE extraction_source END AS extraction_source,
  array_to_string(list_sort(CASE WHEN hit THEN skills ELSE skills_fallback END), ',') AS skills_fallback FROM hit""",
)
def rebuild_extraction(spark, sf_dir):
    done = rebuild.rebuild_extraction(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir), _BATCH, _LIMIT, _CEILING)
    return done.select(
        "id", sorted_tags(F.col("skills"), "skills"), "remote_policy", "salary_min", "salary_max", "salary_currency",
        "extraction_source", sorted_tags(F.col("skills_fallback"), "skills_fallback"),
    )


@query(
    "rebuild_stats",
    f"""{_PLANNED}, n AS (SELECT count(*) AS processed, count(*) FILTER (ok) AS updated, count(*) FILTER (NOT ok) AS failed,
  CAST(sum(tin) AS BIGINT) AS prompt_tokens, CAST(sum(tout) AS BIGINT) AS completion_tokens FROM plan WHERE done)
SELECT (SELECT count(*) FROM jobs WHERE {_PENDING}) AS total_target, n.*, round({_cost('prompt_tokens', 'completion_tokens')}, 6) AS cost,
  {_cost('prompt_tokens', 'completion_tokens')} >= {_CEILING} AS halted FROM n""",
)
def rebuild_stats(spark, sf_dir):
    stats = rebuild.rebuild_stats(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir), _BATCH, _LIMIT, _CEILING)
    return stats.withColumn("cost", F.round("cost", 6))


_LABEL = "(['engineering','data','product','design','marketing','sales','ops','other'])[k % 8 + 1]"


@query(
    "label_role_family",
    f"""{_REBUILD}, {_plan_sql('role_family IS NULL', 2.0, None, 100)} SELECT m.id,
  CASE WHEN p.done AND p.ok THEN {_LABEL} ELSE role_family END AS role_family FROM merged m LEFT JOIN plan p USING (id)""",
)
def label_role_family(spark, sf_dir):
    labels = X.postings(spark, sf_dir).select(
        F.col("id").alias("job_id"), X._pick(C.ROLE_FAMILIES, F.col("k") % 8).alias("role_family")
    )
    replies = X.outcomes(spark, sf_dir).select("job_id", "ok", "prompt_tokens", "completion_tokens").join(labels, "job_id")
    done = rebuild.label_role_family(X.jobs(spark, sf_dir), replies, 100, None, 2.0)
    return done.select("id", "role_family")


_COMPARED = f"""{_REBUILD}, cmp AS (SELECT *, list_distinct(o_skills) AS nw, list_filter(o_skills, lambda x: NOT list_contains(skills, x)) AS gained,
  list_filter(skills, lambda x: NOT list_contains(o_skills, x)) AS lost FROM merged WHERE ok)"""


@query(
    "extraction_compare",
    f"""{_COMPARED}, d AS (SELECT avg(len(skills)) AS heuristic_skill_avg, avg(len(nw)) AS model_skill_avg,
  count(*) FILTER (remote_policy <> m_remote) AS remote_changed, count(*) FILTER (m_max IS NOT NULL AND salary_max IS NULL) AS salary_added,
  count(*) FILTER (m_max IS NULL AND salary_max IS NOT NULL) AS salary_removed, count(*) FILTER (len(gained) = 0 AND len(lost) > 0) AS narrower,
  count(*) FILTER (len(gained) > 0) AS broader, count(*) FILTER (len(skills) > 0 AND len(nw) = 0) AS emptied FROM cmp),
t AS (SELECT count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, CAST(sum(tin) AS BIGINT) AS prompt_tokens,
  CAST(sum(tout) AS BIGINT) AS completion_tokens FROM outcomes)
SELECT n, ok, failed, prompt_tokens, completion_tokens, round({_cost('prompt_tokens', 'completion_tokens')}, 6) AS cost,
  d.* REPLACE (round(heuristic_skill_avg, 6) AS heuristic_skill_avg, round(model_skill_avg, 6) AS model_skill_avg) FROM t, d""",
)
def extraction_compare(spark, sf_dir):
    report = rebuild.comparison_report(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ("cost", "heuristic_skill_avg", "model_skill_avg")})


@query(
    "extraction_examples",
    f"""{_COMPARED} SELECT id, company_id, substr(title, 1, 48) AS title, {sql_sorted('skills', 'heuristic')}, {sql_sorted('nw', 'model')}, remote_policy AS heuristic_remote,
  m_remote AS model_remote FROM cmp WHERE len(gained) + len(lost) > 0 OR remote_policy <> m_remote ORDER BY id LIMIT 12""",
)
def extraction_examples(spark, sf_dir):
    rows = rebuild.comparison_examples(X.jobs(spark, sf_dir), X.outcomes(spark, sf_dir))
    return rows.select(
        "id", "company_id", "title", F.array_join("heuristic_skills", ",").alias("heuristic"),
        F.array_join("model_skills", ",").alias("model"), "heuristic_remote", "model_remote",
    )


@query(
    "cost_extrapolate",
    f"""{_REBUILD}, e AS (SELECT {_cost('sum(tin)', 'sum(tout)')} / count(*) FILTER (ok) * (SELECT count(*) FROM jobs) AS e FROM outcomes)
SELECT round(e, 6) AS estimate, e > 50 AS over_ceiling FROM e""",
)
def cost_extrapolate(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    report = rebuild.comparison_report(jobs, X.outcomes(spark, sf_dir))
    total = jobs.agg(F.count(F.lit(1))).scalar()
    return rebuild.extrapolated_cost(report, total).select(F.round("estimate", 6).alias("estimate"), "over_ceiling")


@query("sample_rows", f"{O.JOBS} SELECT id FROM jobs ORDER BY md5(id || 'salt') LIMIT 100")
def sample_rows(spark, sf_dir):
    return rebuild.sample_rows(X.jobs(spark, sf_dir), 100, "salt").select("id")


# --- repairs --------------------------------------------------------------------------


def _stale(jobs):
    """The state before real posting dates were known."""
    return jobs.withColumn("posted_at", F.when(F.size("skills") > 2, F.col("posted_at")))


_BACKFILL = f"""{O.INGEST}, old AS (SELECT * REPLACE (CASE WHEN len(skills) > 2 THEN posted_at END AS posted_at) FROM state),
b AS (SELECT s.id, s.delisted_at, s.first_seen_at, s.relist_count, s.ghost_score AS g, c.ok, CASE WHEN NOT c.ok THEN NULL WHEN f.id IS NULL THEN 'unmatched'
    WHEN f.posted_at IS NULL THEN 'undated' ELSE 'dated' END AS match,
  CASE WHEN f.posted_at IS NOT NULL THEN f.posted_at ELSE s.posted_at END AS posted_at,
  CASE WHEN f.posted_at IS NOT NULL THEN f.updated_at ELSE s.updated_at END AS updated_at
  FROM old s JOIN crawls c USING (company_id) LEFT JOIN feed f ON f.id = s.id)"""


@query(
    "backfill_dates",
    f"""{_BACKFILL} SELECT id, {sql_stamp('posted_at')}, {sql_stamp('updated_at')}, round(CASE WHEN ok AND delisted_at IS NULL
  THEN {O.ghost('relist_count', 'coalesce(posted_at, first_seen_at)')} ELSE g END, 6) AS ghost_score FROM b""",
)
def backfill_dates(spark, sf_dir):
    jobs = _stale(X.state(spark, sf_dir, with_text=False))
    done = maintenance.backfill_dates(jobs, X.feed(spark, sf_dir), X.crawls(spark, sf_dir), X.now())
    return done.select("id", stamp("posted_at"), stamp("updated_at"), rounded(F.col("ghost_score"), "ghost_score"))


@query(
    "backfill_stats",
    f"""{_BACKFILL} SELECT count(*) FILTER (match = 'dated') AS jobs_dated, count(*) FILTER (match = 'undated') AS jobs_no_ats_date,
  count(*) FILTER (match = 'unmatched') AS jobs_unmatched, count(*) FILTER (ok AND delisted_at IS NULL) AS ghost_recomputed,
  (SELECT count(*) FROM crawls WHERE ok) AS companies_fetched, (SELECT count(*) FROM crawls WHERE NOT ok) AS companies_failed FROM b""",
)
def backfill_stats(spark, sf_dir):
    jobs = _stale(X.state(spark, sf_dir, with_text=False))
    return maintenance.backfill_stats(jobs, X.feed(spark, sf_dir), X.crawls(spark, sf_dir))


def _orphaned(spark, sf_dir):
    """Companies without the ones in debt, so that some postings have no company."""
    good = X.table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("c"), "s_suppkey").alias("id"))
    return X.companies(spark, sf_dir).join(good, "id", "left_semi")


_REGEN = f"""{O.JOBS}, good AS (SELECT 'c' || s_suppkey AS company_id FROM supplier WHERE s_acctbal >= 0),
r AS (SELECT j.id, j.company_id, apply_channel AS old, g.company_id IS NOT NULL AS has,
  {O.resolved('vendor', 'tenant', 'ats_job_id', 'apply_channel')} AS url, NOT {O.trusted('vendor', 'ats_job_id', 'apply_channel')} AS fb,
  {O.authority('apply_channel')} NOT IN ('', 'boards.greenhouse.io', 'job-boards.greenhouse.io', 'jobs.lever.co', 'jobs.ashbyhq.com') AS embed
  FROM jobs j LEFT JOIN good g USING (company_id))"""


@query("regen_apply", f"{_REGEN} SELECT id, CASE WHEN has THEN url ELSE old END AS apply_channel FROM r")
def regen_apply(spark, sf_dir):
    done = maintenance.regenerate_apply_channels(X.jobs(spark, sf_dir), _orphaned(spark, sf_dir))
    return done.select("id", "apply_channel")


@query(
    "regen_stats",
    f"""{_REGEN} SELECT count(*) AS jobs_total, count(*) FILTER (has AND url <> old) AS jobs_rewritten, count(*) FILTER (has AND fb) AS jobs_fallback,
  count(*) FILTER (has AND embed) AS embed_jobs FROM r""",
)
def regen_stats(spark, sf_dir):
    return maintenance.regeneration_stats(X.jobs(spark, sf_dir), _orphaned(spark, sf_dir))


@query("embed_companies", f"{_REGEN} SELECT company_id, count(*) AS embed_jobs FROM r WHERE has AND embed GROUP BY 1")
def embed_companies(spark, sf_dir):
    return maintenance.embed_companies(X.jobs(spark, sf_dir), _orphaned(spark, sf_dir))


@query(
    "snapshot_stats",
    f"""{O.JOBS} SELECT (SELECT count(*) FROM companies) AS companies, count(*) AS jobs, {sql_stamp('max(verified_at)', 'data_as_of')},
  CAST(floor({O.days_between('max(verified_at)', "TIMESTAMP '2001-08-20 06:00:00'")}) AS BIGINT) AS age_days FROM jobs""",
)
def snapshot(spark, sf_dir):
    stats = snapshot_stats(X.jobs(spark, sf_dir), X.companies(spark, sf_dir), "2001-08-20 06:00:00")
    return stats.select("companies", "jobs", stamp("data_as_of"), "age_days")
