"""Standing queries, authorisations and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata import schemas
from jobstrata.operators import authorize, guards, predicates, search, status, watches
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import joined, query, registered_sql, rounded, sql_stamp, stamp
from jobstrata.plans.search_plans import _flat, record_sql
from jobstrata.session import shared_root
from jobstrata.sources.state import StateStore
from jobstrata.streaming.watch_totals import count_changes, register_kept, totals

_W = "(['python','rust','go','k8s','sql','aws','llm','rag','cuda','java'])"
_WATCHES = f"""watches AS (
  SELECT c_custkey AS c, 'w_' || c_custkey AS watch_id, '#f' || c_custkey % 20 AS fingerprint,
    CASE WHEN c_custkey % 8 = 7 THEN [] ELSE list_distinct([{_W}[c_custkey % 10 + 1], {_W}[(3 * c_custkey) % 10 + 1]]) END AS want,
    CASE WHEN c_custkey % 4 = 0 THEN [{_W}[c_custkey % 10 + 1]] WHEN c_custkey % 16 = 15 THEN [{_W}[(3 * c_custkey) % 10 + 1]] ELSE [] END AS need,
    c_custkey % 3 = 0 AS remote_only, CASE WHEN c_custkey % 7 = 0 THEN 'engineering' END AS family,
    CASE WHEN c_custkey % 5 = 0 THEN abs(floor(c_acctbal / 1000)) * 50000 END AS floor_pay,
    CASE WHEN c_custkey % 2 = 1 THEN TIMESTAMP '1999-01-01' + to_days(CAST(c_custkey % 30 * 20 AS INTEGER)) END AS since,
    c_custkey % 11 <> 0 AS active FROM customer)"""
_MATCHES = f"""live AS (SELECT * FROM jobs WHERE delisted_at IS NULL),
groups AS (SELECT DISTINCT want, need, remote_only, family, floor_pay, since FROM watches WHERE active),
matches AS (SELECT g.*, j.*, CASE WHEN len(want) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(want, skills)) / len(want)::DOUBLE END AS mq
  FROM groups g JOIN live j ON (NOT remote_only OR remote_policy = 'remote') AND (family IS NULL OR role_family = family)
    AND (floor_pay IS NULL OR salary_max >= floor_pay OR salary_min >= floor_pay OR (salary_min IS NULL AND salary_max IS NULL))
    AND (since IS NULL OR first_seen_at > since) AND (len(want) = 0 OR list_has_any(skills, want)) AND list_has_all(skills, need))"""
_BOTH = f"{O.JOBS}, {_WATCHES}, {_MATCHES}"
_SAME = " AND ".join(f"w.{c} IS NOT DISTINCT FROM m.{c}" for c in ("want", "need", "remote_only", "family", "floor_pay", "since"))
_MSCORE = f"(0.7::DOUBLE * mq + 0.3::DOUBLE * {O.fresh('verified_at')})"
_TOP = f"""top AS (SELECT *, row_number() OVER (PARTITION BY want, need, remote_only, family, floor_pay, since ORDER BY {_MSCORE} DESC, id) AS rank
  FROM matches QUALIFY rank <= 20)"""


@query(
    "watch_matches",
    f"""{_BOTH}, n AS (SELECT want, need, remote_only, family, floor_pay, since, count(*) AS n, max(mq) AS best FROM matches GROUP BY ALL)
SELECT watch_id, coalesce(n, 0) AS matches, round(best, 6) AS best_match FROM watches w LEFT JOIN n m ON {_SAME} WHERE active""",
)
def watch_matches(spark, sf_dir):
    found = watches.match_counts(X.watches(spark, sf_dir), X.jobs(spark, sf_dir), X.now())
    return found.select("watch_id", "matches", rounded(F.col("best_match"), "best_match"))


# The same watches, each with a salary floor and a cursor of its own.
_OWN = _WATCHES.replace("watches AS (", "plain_watches AS (", 1) + """, watches AS (SELECT * REPLACE (20000 + (c * 7919) % 300000 AS floor_pay,
    TIMESTAMP '1992-01-01' + to_seconds((c * 104729) % 200000000) AS since) FROM plain_watches)"""


@query(
    "watch_counts",
    f"""{O.JOBS}, {_OWN}, {_MATCHES}, n AS (SELECT want, need, remote_only, family, floor_pay, since, count(*) AS n, max(mq) AS best FROM matches GROUP BY ALL)
SELECT watch_id, coalesce(n, 0) AS matches, round(best, 6) AS best_match FROM watches w LEFT JOIN n m ON {_SAME} WHERE active""",
)
def watch_counts(spark, sf_dir):
    number = F.substring_index("watch_id", "_", -1).cast("bigint")
    cursor = F.timestamp_seconds(F.lit(694_224_000) + number * 104_729 % 200_000_000)
    own = X.watches(spark, sf_dir).withColumns(
        {"filters": F.col("filters").withField("min_salary", (20_000 + number * 7919 % 300_000).cast("int")), "last_notified_at": cursor}
    )
    found = watches.match_counts(own, X.jobs(spark, sf_dir), X.now())
    return found.select("watch_id", "matches", rounded(F.col("best_match"), "best_match"))


@query("watch_index_matches", registered_sql("watch_matches"))
def watch_index_matches(spark, sf_dir):
    """Counts kept by an inverted table of the watches. Postings appear, some of them unfinished, are completed and partly delisted,
    in three batches of changes; half of the watches are registered before, half between the second and the third."""
    store = StateStore(spark, shared_root(spark))
    asked, jobs = X.watches(spark, sf_dir), X.jobs(spark, sf_dir)
    number = F.substring_index("watch_id", "_", -1).cast("bigint")
    k = F.substring_index("id", ":", -1).cast("bigint")
    live = jobs.withColumn("delisted_at", F.lit(None).cast("timestamp"))
    unfinished = live.withColumns({"skills": F.array().cast("array<string>"), "salary_min": F.lit(None).cast("int"), "salary_max": F.lit(None).cast("int")})

    def side(rows, name):
        return rows.select("id", "company_id", F.struct(*[F.col(f.name).cast(f.dataType) for f in schemas.JOBS.fields]).alias(name))

    def changes(kind, before, after):
        both = side(after, "after") if before is None else side(before, "before").join(side(after, "after").drop("company_id"), "id")
        row = both.withColumns({"change": F.lit(kind), "at": X.now(), **({"before": F.lit(None)} if before is None else {})})
        return row.select([F.col(f.name).cast(f.dataType) for f in schemas.CHANGES.fields])

    early, late = k % 3 != 0, k % 5 == 0
    steps = [
        changes("new", None, live.filter(early & ~late).unionByName(unfinished.filter(early & late))),
        changes("updated", unfinished.filter(early & late), live.filter(early & late)).unionByName(changes("new", None, live.filter(~early))),
        changes("delisted", live, jobs.filter("delisted_at IS NOT NULL")),
    ]
    register_kept(store, asked.filter(number % 2 == 0), jobs.filter("false"))
    count_changes(store, steps[0], "step-0")
    count_changes(store, steps[1], "step-1")
    register_kept(store, asked.filter(number % 2 == 1), live)
    count_changes(store, steps[2], "step-2")
    return totals(store).select("watch_id", "matches", rounded(F.col("best_match"), "best_match"))


@query(
    "check_watches_caller",
    f"""{_BOTH}, {_TOP}, hits AS (SELECT w.watch_id, m.id, m.rank, {_MSCORE} AS score FROM watches w JOIN top m ON {_SAME} WHERE active AND fingerprint = '#f3')
SELECT w.watch_id, {sql_stamp('w.since', 'since')}, (SELECT count(*) FROM hits x WHERE x.watch_id = w.watch_id) AS new_matches, h.rank, h.id, round(h.score, 6) AS score
FROM watches w LEFT JOIN hits h ON h.watch_id = w.watch_id WHERE active AND fingerprint = '#f3'""",
)
def check_watches_caller(spark, sf_dir):
    """One caller's check, a row per match shown, and one for each watch without any."""
    report, _ = watches.check_caller(X.watches(spark, sf_dir), X.jobs(spark, sf_dir), X.now(), "#f3")
    rows = report.select("watch_id", stamp("since"), F.col("new_matches").cast("bigint").alias("new_matches"), F.explode_outer("matches").alias("m"))
    return rows.select("watch_id", "since", "new_matches", F.col("m.rank").cast("bigint").alias("rank"), "m.id", rounded(F.col("m.score"), "score"))


@query(
    "watch_top20",
    f"""{_BOTH}, {_TOP} SELECT w.watch_id, m.id, m.rank, round({_MSCORE}, 6) AS score FROM watches w JOIN top m ON {_SAME} WHERE active""",
)
def watch_top20(spark, sf_dir):
    best = watches.top_matches(X.watches(spark, sf_dir), X.jobs(spark, sf_dir), X.now())
    return best.select("watch_id", "id", F.col("rank").cast("bigint").alias("rank"), rounded(F.col("score"), "score"))


@query(
    "check_watches",
    f"{_BOTH}, {_TOP} " + record_sql(f"SELECT w.watch_id, m.* FROM watches w JOIN top m ON {_SAME} WHERE active", "watch_id,"),
)
def check_watches(spark, sf_dir):
    jobs, asked = X.jobs(spark, sf_dir), X.watches(spark, sf_dir)
    best, _ = watches.check_watches(asked, jobs, X.now())
    wanted = asked.select("watch_id", F.col("filters.skills").alias("wanted"))
    hits = best.select("watch_id", "id").join(jobs, "id").join(wanted, "watch_id")
    return _flat(search.posting_records(hits, X.companies(spark, sf_dir), F.col("wanted"), X.now()))


@query(
    "watch_cursor_advance",
    f"{O.POSTINGS}, {_WATCHES} SELECT watch_id, strftime(CASE WHEN active THEN {O.NOW} ELSE since END, '%Y-%m-%d %H:%M:%S') AS last_notified_at FROM watches",
)
def watch_cursor_advance(spark, sf_dir):
    return watches.advance_cursor(X.watches(spark, sf_dir), X.now()).select("watch_id", stamp("last_notified_at"))


@query("watches_active", f"{O.POSTINGS}, {_WATCHES} SELECT watch_id FROM watches WHERE active AND fingerprint = '#f3'")
def watches_active(spark, sf_dir):
    return X.watches(spark, sf_dir).filter(predicates.active_watch("#f3")).select("watch_id")


@query(
    "identity_status",
    f"{O.POSTINGS}, {_WATCHES} SELECT fingerprint, count(*) AS active_watches FROM watches WHERE active GROUP BY 1",
)
def identity_status(spark, sf_dir):
    return status.identity_status(X.watches(spark, sf_dir))


# --- registration ---------------------------------------------------------------------


def _requests(spark, sf_dir):
    """Watch requests as callers send them: string maps, some with personal keys."""
    c = F.col("c_custkey")
    entries = [
        ("skills", F.when(c % 4 != 3, F.concat(F.lit("Rust, "), F.lower("c_mktsegment")))),
        ("required_skills", F.when(c % 6 == 0, F.lit("SQL"))),
        ("remote", F.when(c % 3 == 0, F.lit("true")).when(c % 3 == 1, F.lit("false"))),
        ("role_family", F.when(c % 5 == 0, F.lit("Engineering"))),
        ("min_salary", F.when(c % 2 == 0, F.concat((c % 300 + 1).cast("string"), F.lit("k")))),
        ("email", F.when(c % 13 == 0, F.lit("a@example.com"))),
        ("Phone", F.when(c % 17 == 0, F.lit("555"))),
    ]
    full = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries]))
    token = F.concat(F.lit("#f"), c)
    return X.table(spark, sf_dir, "customer").select(
        c.cast("string").alias("request_id"),
        F.when(c % 19 == 0, F.concat(token, F.lit("\nJane Doe"))).when(c % 23 == 0, F.repeat(token, 101)).otherwise(token).alias("fingerprint"),
        F.map_filter(full, lambda _, v: v.isNotNull()).alias("filters"),
    )


_TOKEN = "CASE WHEN c_custkey % 19 = 0 THEN '#f' || c_custkey || chr(10) || 'Jane Doe' WHEN c_custkey % 23 = 0 THEN repeat('#f' || c_custkey, 101) ELSE '#f' || c_custkey END"
_REQUESTS = f"requests AS (SELECT c_custkey AS c, c_mktsegment, {_TOKEN} AS fingerprint FROM customer)"
_SHAPED_TOKEN = "(length(fingerprint) <= 200 AND NOT contains(fingerprint, chr(10)))"


@query(
    "watch_register",
    f"""WITH {_REQUESTS} SELECT 'w_' || substr(sha256(c || chr(31) || fingerprint), 1, 16) AS watch_id, fingerprint,
  CASE WHEN c % 4 <> 3 THEN 'rust,' || lower(c_mktsegment) ELSE '' END AS skills, CASE WHEN c % 6 = 0 THEN 'sql' ELSE '' END AS required_skills,
  CASE c % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote, CASE WHEN c % 5 = 0 THEN 'engineering' END AS role_family,
  CASE WHEN c % 2 = 0 THEN CAST((c % 300 + 1) * 1000 AS INTEGER) END AS min_salary, true AS active
FROM requests WHERE {_SHAPED_TOKEN} AND c % 13 <> 0""",
)
def watch_register(spark, sf_dir):
    rows = watches.register_watches(_requests(spark, sf_dir), X.now())
    return rows.select(
        "watch_id", "fingerprint", joined(F.col("filters.skills"), "skills"), joined(F.col("filters.required_skills"), "required_skills"),
        "filters.remote", "filters.role_family", "filters.min_salary", "active",
    )


@query(
    "guard_filter_keys",
    f"""WITH {_REQUESTS} SELECT CAST(c AS VARCHAR) AS request_id, CASE WHEN NOT {_SHAPED_TOKEN} THEN 'ERR_RESUME_NEVER_TRANSMITTED'
  WHEN c % 13 = 0 THEN 'ERR_PII_NOT_ACCEPTED' END AS error, CASE WHEN c % 13 = 0 THEN 'email' ELSE '' END AS leaked FROM requests""",
)
def guard_filter_keys(spark, sf_dir):
    leaked = joined(guards.leaked_filter_keys(F.map_keys("filters")), "leaked")
    return watches.judge_requests(_requests(spark, sf_dir)).select("request_id", "error", leaked)


@query("guard_anonymous", f"WITH {_REQUESTS} SELECT c, {_SHAPED_TOKEN} AS anonymous FROM requests")
def guard_anonymous(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        F.col("request_id").cast("bigint").alias("c"), guards.is_anonymous(F.col("fingerprint")).alias("anonymous")
    )


# --- authorisation --------------------------------------------------------------------


def _authorisations(spark, sf_dir):
    """One request per customer for the posting of the order seven times its key; some do not exist."""
    c = F.col("c_custkey")
    ids = X.postings(spark, sf_dir).select(F.col("k").alias("target"), "id")
    extra = F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("Resume"), F.lit("note"), F.lit("LinkedIn")),
            F.array(F.when(c % 17 == 0, "text"), F.lit("hello"), F.when(c % 29 == 0, "url")),
        ),
        lambda _, v: v.isNotNull(),
    )
    token = F.concat(F.lit("#f"), c)
    asked = X.table(spark, sf_dir, "customer").select(
        c.cast("string").alias("request_id"),
        (c * 7 + c % 3 * 8000).alias("target"),
        F.when(c % 13 == 0, F.concat(token, F.lit("\nCV: ..."))).otherwise(token).alias("fingerprint"),
        F.when(c % 31 != 0, c % 5 != 0).alias("authorized"),
        extra.alias("extra"),
    )
    return asked.join(ids, "target", "left").select(
        "request_id", F.coalesce("id", F.lit("c0:none")).alias("job_id"), "fingerprint", "authorized", "extra"
    )


_ASKED = f"""asked AS (SELECT c_custkey AS c, coalesce(j.id, 'c0:none') AS job_id, j.apply_channel,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 29 = 0 OR c_custkey % 13 = 0 THEN 'ERR_RESUME_NEVER_TRANSMITTED'
      WHEN c_custkey % 31 = 0 OR c_custkey % 5 = 0 THEN 'ERR_NOT_AUTHORIZED' WHEN j.id IS NULL THEN 'ERR_JOB_NOT_FOUND' END AS error
  FROM customer LEFT JOIN jobs j ON j.k = c_custkey * 7 + c_custkey % 3 * 8000)"""


@query(
    "authorize_batch",
    f"{O.JOBS}, {_ASKED} SELECT CAST(c AS VARCHAR) AS request_id, job_id, error, CASE WHEN error IS NULL THEN apply_channel END AS apply_channel FROM asked",
)
def authorize_batch(spark, sf_dir):
    judged = authorize.judge(_authorisations(spark, sf_dir), X.jobs(spark, sf_dir))
    return judged.select(
        "request_id", "job_id", "error", F.when(F.col("error").isNull(), F.col("apply_channel")).alias("apply_channel")
    )


@query(
    "authorize_receipts",
    f"""{O.JOBS}, {_ASKED} SELECT 'r_' || substr(sha256(c || chr(31) || job_id || chr(31) || '#f' || c), 1, 16) AS receipt_id, job_id,
  '#f' || c AS fingerprint, 'employer_site' AS delivered_via, false AS resume_transmitted, apply_channel FROM asked WHERE error IS NULL""",
)
def authorize_receipts(spark, sf_dir):
    judged = authorize.judge(_authorisations(spark, sf_dir), X.jobs(spark, sf_dir))
    return authorize.accepted(judged, X.now()).select(
        "receipt_id", "job_id", "fingerprint", "delivered_via", "resume_transmitted", "apply_channel"
    )


@query(
    "guard_resume_keys",
    """SELECT CAST(c_custkey AS VARCHAR) AS request_id, concat_ws(',', CASE WHEN c_custkey % 29 = 0 THEN 'linkedin' END,
  CASE WHEN c_custkey % 17 = 0 THEN 'resume' END) AS leaked FROM customer""",
)
def guard_resume_keys(spark, sf_dir):
    leaked = joined(guards.leaked_argument_keys(F.map_keys("extra")), "leaked")
    return _authorisations(spark, sf_dir).select("request_id", leaked)


@query(
    "guard_source",
    f"{O.JOBS} SELECT count(*) AS postings, count(*) FILTER (source NOT IN ('employer_site', 'ats_public_api')) AS \"foreign\" FROM jobs",
)
def guard_source(spark, sf_dir):
    return guards.foreign_sources(X.jobs(spark, sf_dir))


_AGAIN = O.resolved("vendor", "tenant", "ats_job_id", "apply_channel")


@query(
    "guard_apply_channel",
    f"""{O.JOBS} SELECT id, starts_with(apply_channel, 'https://') AS is_https, {O.authority('apply_channel')} IN ('boards.greenhouse.io',
  'job-boards.greenhouse.io', 'jobs.lever.co', 'jobs.ashbyhq.com') AS on_ats_host, contains(apply_channel, ats_job_id) AS has_job_id,
  {_AGAIN} = apply_channel AS is_stable FROM jobs""",
)
def guard_apply_channel(spark, sf_dir):
    return guards.apply_channel_report(X.jobs(spark, sf_dir), X.companies(spark, sf_dir))



@query(
    "guard_schema",
    f"""WITH {_WATCHES} SELECT 'email' AS column, count(CASE WHEN c % 13 = 0 THEN 1 END) AS filled FROM watches
UNION ALL SELECT 'resume_text', count(CASE WHEN c % 17 = 0 THEN 1 END) FROM watches""",
)
def guard_schema(spark, sf_dir):
    """A caller-owned table as it should be, which reports nothing, and the same after two columns crept in."""
    good = X.watches(spark, sf_dir)
    number = F.substring_index("watch_id", "_", -1).cast("bigint")
    drifted = good.withColumns({"email": F.when(number % 13 == 0, "a@b.c"), "resume_text": F.when(number % 17 == 0, "text")})
    return guards.schema_report(good, schemas.WATCHES).union(guards.schema_report(drifted, schemas.WATCHES))
