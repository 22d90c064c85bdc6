"""Streams, stored state, plug-ins and repository scans, run over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata import schemas
from jobstrata.functions import skills as S
from jobstrata.operators import fingerprint, maintenance, rebuild, status
from jobstrata.operators.ingest import accepted_feed
from jobstrata.operators.plugins import extract_with
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.change_plans import _AFTER, _CHANGES, _ROW, _row
from jobstrata.plans.registry import joined, query, registered_sql, sorted_tags, sql_sorted, sql_stamp, stamp
from jobstrata.plans.scalar_plans import facts_sql
from jobstrata.plans.watch_plans import _BOTH, _MSCORE, _SAME, _TOP
from jobstrata.session import shared_root
from jobstrata.sources import receipts, repo_files, snapshot
from jobstrata.sources.bootstrap import bootstrap
from jobstrata.sources.state import BUCKETS, CODEC, StateStore, bucket_of
from jobstrata.streaming.change_stream import start_changes
from jobstrata.streaming.ingest_stream import apply_pages, start_ingest
from jobstrata.streaming.lifecycle_stream import SPANS, start_lifecycle
from jobstrata.streaming.watch_stream import start_matching

_ONCE = {"availableNow": True}


# --- crawls through storage -------------------------------------------------------------

# The payloads hide some postings of one vendor; everything else is the plain feed.
_LISTED = O.INGEST.replace(
    "WHERE in_feed AND ok", "WHERE in_feed AND ok AND NOT (vendor = 'ashby' AND k % 3 <> 0 AND k % 11 = 0)"
)


# A stream also ignores crawls that are no newer than the company's last one.
_STREAMED = _LISTED.replace(
    "s_suppkey % 13 <> 0 AS ok", "(s_suppkey % 13 <> 0 AND (s_suppkey % 40 <> 0 OR s_suppkey % 10 = 9)) AS ok"
)


# What a payload says of pay is checked by the salary queries; it differs from the plain feed's.
_PAY = ["salary_min", "salary_max", "salary_currency"]


@query("stream_ingest", f"{_STREAMED}, {_AFTER}, shown AS (SELECT {_ROW} FROM after) SELECT * EXCLUDE (salary_min, salary_max, salary_currency) FROM shown")
def stream_ingest(spark, sf_dir):
    """Three crawls per company through the file stream, in four batches: the one that counts, split over two of them with
    some pages twice; a later one that fails; and a later one of which only some pages land."""
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    store.write({"jobs": X.state(spark, sf_dir), "companies": X.companies(spark, sf_dir)})
    X.landing(spark, sf_dir).write.option("compression", CODEC).parquet(f"{root}/made")
    pages = spark.read.schema(schemas.LANDING).parquet(f"{root}/made")
    odd = F.col("page_no") % 2 == 1

    def at(hours: int):
        return X.now() + F.make_dt_interval(hours=F.lit(hours))

    # Failed crawls land before the good one of the same companies is whole.
    failed = pages.select("company_id", "vendor", "tenant").distinct().withColumns(
        {
            "page_no": F.lit(0).cast("bigint"), "status": F.lit(503), "body": F.lit(None).cast("string"), "error": F.lit(None).cast("string"),
            "crawl_ts": at(2), "page_count": F.lit(None).cast("bigint"),
        }
    )
    partial = pages.filter(odd).withColumns({"crawl_ts": at(3), "page_count": F.lit(10**6).cast("bigint")})
    for number, batch in enumerate([pages.filter(odd), failed, pages, partial]):
        batch.select(schemas.LANDING.fieldNames()).write.option("compression", CODEC).parquet(f"{root}/pages/part={number}")
        start_ingest(store, f"{root}/pages/*", f"{root}/checkpoint", _ONCE).awaitTermination()
    return _row(store.read("jobs", schemas.JOBS)).drop(*_PAY)


@query(
    "stream_changes",
    f"""{_LISTED}, {_CHANGES}, {_AFTER}, kinds AS (SELECT id, CASE WHEN revived THEN 'revived' ELSE change END AS change FROM changes)
SELECT id, a.company_id, change, s.title AS title_before, a.title AS title_after, {sql_stamp('s.delisted_at', 'delisted_before')},
  {sql_stamp('a.delisted_at', 'delisted_after')}, {sql_sorted('a.skills', 'skills_after')}, md5(a.description_raw) AS body_after, {sql_stamp(O.NOW, 'at')}
FROM kinds JOIN after a USING (id) LEFT JOIN state s USING (id) WHERE change IN ('new', 'updated', 'delisted', 'revived')""",
)
def stream_changes(spark, sf_dir):
    """A crawl applied in two steps, half of the companies each, and the changes followed as a stream after each of them."""
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    never = F.lit(None).cast("timestamp")
    store.write({"jobs": X.state(spark, sf_dir), "companies": X.companies(spark, sf_dir).withColumn("last_crawled_at", never)})
    X.landing(spark, sf_dir).write.option("compression", CODEC).parquet(f"{root}/made")
    pages = spark.read.schema(schemas.LANDING).parquet(f"{root}/made")

    def handle(changes, tag, version):
        changes.write.mode("overwrite").parquet(f"{root}/followed/batch={tag}")

    for half in (0, 1):
        pages.filter(F.pmod(F.xxhash64("company_id"), F.lit(2)) == half).write.option("compression", CODEC).parquet(f"{root}/pages/part={half}")
        start_ingest(store, f"{root}/pages/*", f"{root}/check-in", _ONCE).awaitTermination()
        start_changes(store, handle, f"{root}/check-out", _ONCE).awaitTermination()
    followed = spark.read.schema(schemas.CHANGES).parquet(f"{root}/followed")
    return followed.select(
        "id", "company_id", "change", F.col("before.title").alias("title_before"), F.col("after.title").alias("title_after"),
        F.date_format("before.delisted_at", "yyyy-MM-dd HH:mm:ss").alias("delisted_before"), F.date_format("after.delisted_at", "yyyy-MM-dd HH:mm:ss").alias("delisted_after"),
        sorted_tags(F.col("after.skills"), "skills_after"), F.md5("after.description_raw").alias("body_after"), stamp("at"),
    )


@query("state_buckets", f"{_LISTED}, {_AFTER}, shown AS (SELECT {_ROW} FROM after) SELECT * EXCLUDE (salary_min, salary_max, salary_currency) FROM shown")
def state_buckets(spark, sf_dir):
    """A crawl applied in two steps, half of the companies each, to an index kept in buckets: each step replaces the buckets it touches."""
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    never = F.lit(None).cast("timestamp")
    store.write(
        {"companies": X.companies(spark, sf_dir).withColumn("last_crawled_at", never)}, buckets={"jobs": (X.state(spark, sf_dir), list(range(BUCKETS)))}
    )
    X.landing(spark, sf_dir).write.option("compression", CODEC).parquet(f"{root}/made")
    pages = spark.read.schema(schemas.LANDING).parquet(f"{root}/made")
    for half in (0, 1):
        apply_pages(store, pages.filter(bucket_of(F.col("company_id")) % 2 == half), f"half-{half}")
    return _row(store.read("jobs", schemas.JOBS)).drop(*_PAY)


_BOOT = f"""{_LISTED}, facts AS ({facts_sql('feed')}), boot AS (
  SELECT f.*, x.f_skills AS b_skills, x.f_remote AS b_remote FROM feed f JOIN facts x USING (id))"""


@query(
    "bootstrap_refresh",
    f"""{_BOOT} SELECT id, company_id, title, md5(description_raw) AS body, {sql_sorted('b_skills', 'skills')}, CAST(NULL AS VARCHAR) AS role_family, b_remote AS remote_policy,
  location, {sql_stamp('posted_at')}, {sql_stamp('updated_at')}, {sql_stamp(O.NOW, 'first_seen_at')},
  {sql_stamp(O.NOW, 'verified_at')}, CAST(NULL AS VARCHAR) AS delisted_at, 0 AS relist_count,
  round({O.ghost('0', f'coalesce(posted_at, {O.NOW})')}, 6) AS ghost_score, apply_channel, content_hash, 'heuristic' AS extraction_source, '' AS skills_fallback FROM boot""",
)
def bootstrap_refresh(spark, sf_dir):
    """An index from nothing: candidates seeded from the crawl, then the crawl applied."""
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    X.landing(spark, sf_dir).write.option("compression", CODEC).parquet(f"{root}/pages")
    pages = spark.read.schema(schemas.LANDING).parquet(f"{root}/pages")
    # Here the company id is the tenant of the crawl as well.
    candidates = X.companies(spark, sf_dir).select("name", F.col("ats_vendor").alias("vendor"), F.col("id").alias("tenant"))
    bootstrap(store, pages, X.now(), candidates=candidates)
    return _row(store.read("jobs", schemas.JOBS)).drop(*_PAY)


@query(
    "state_roundtrip",
    f"{O.TEXT_JOBS} SELECT id, content_hash, array_to_string(skills, ',') AS skills, {sql_stamp('delisted_at')} FROM jobs",
)
def state_roundtrip(spark, sf_dir):
    """Written, overwritten by a later commit, and read back as of the first one."""
    store = StateStore(spark, shared_root(spark))
    first = store.write({"jobs": X.jobs(spark, sf_dir, with_text=True)})
    store.write({"jobs": X.jobs(spark, sf_dir).filter("delisted_at IS NULL")})
    return store.read("jobs", schemas.JOBS, version=first).select("id", "content_hash", joined(F.col("skills"), "skills"), stamp("delisted_at"))


@query(
    "snapshot_publish",
    f"""{O.JOBS} SELECT (SELECT count(*) FROM companies) AS companies, count(*) AS jobs, {sql_stamp('max(verified_at)', 'data_as_of')},
  0 AS age_days, true AS has_bytes FROM jobs""",
)
def snapshot_publish(spark, sf_dir):
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    store.write({"jobs": X.jobs(spark, sf_dir), "companies": X.companies(spark, sf_dir), "watches": X.watches(spark, sf_dir)})
    stats = snapshot.publish_snapshot(store, f"{root}/snapshot", X.now())
    return stats.select("companies", "jobs", stamp("data_as_of"), "age_days", (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "snapshot_install",
    f"""{O.JOBS} SELECT 'job' AS kind, id, company_id, title, array_to_string(skills, ',') AS detail, remote_policy, salary_min, relist_count,
  round(ghost_score, 6) AS ghost_score, content_hash, {sql_stamp('verified_at')}, {sql_stamp('delisted_at')} FROM jobs
UNION ALL SELECT 'company', id, ats_tenant, name, careers_url, ats_vendor, NULL, NULL, NULL, NULL, {sql_stamp('last_crawled_at')}, NULL FROM companies""",
)
def snapshot_install(spark, sf_dir):
    root = shared_root(spark)
    source, target = StateStore(spark, f"{root}/source"), StateStore(spark, f"{root}/target")
    source.write({"jobs": X.jobs(spark, sf_dir), "companies": X.companies(spark, sf_dir)})
    snapshot.publish_snapshot(source, f"{root}/snapshot", X.now())
    snapshot.install_snapshot(target, f"{root}/snapshot", X.now())
    jobs, companies = target.read("jobs", schemas.JOBS), target.read("companies", schemas.COMPANIES)
    return jobs.select(
        F.lit("job").alias("kind"), "id", "company_id", "title", joined(F.col("skills"), "detail"), "remote_policy", "salary_min", "relist_count",
        F.round("ghost_score", 6).alias("ghost_score"), "content_hash", stamp("verified_at"), stamp("delisted_at"),
    ).unionByName(
        companies.select(
            F.lit("company").alias("kind"), "id", F.col("ats_tenant").alias("company_id"), F.col("name").alias("title"), F.col("careers_url").alias("detail"),
            F.col("ats_vendor").alias("remote_policy"), F.date_format("last_crawled_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at"),
        ),
        allowMissingColumns=True,
    )


@query("schema_evolve", f"{O.JOBS} SELECT id, 'heuristic' AS extraction_source, CAST(NULL AS VARCHAR) AS role_family FROM jobs")
def schema_evolve(spark, sf_dir):
    old = X.jobs(spark, sf_dir).drop(*schemas.LATE_JOB_COLUMNS)
    new, _ = maintenance.add_missing_columns(old)
    return new.select("id", "extraction_source", "role_family")


@query(
    "receipts_log",
    f"""{O.JOBS} SELECT 'r' || j.k AS receipt_id, j.id AS job_id, c.name AS company, title, {sql_stamp('verified_at', 'created_at')}
FROM jobs j JOIN companies c ON c.id = company_id""",
)
def receipts_log(spark, sf_dir):
    """Two appends, one load."""
    path = shared_root(spark)
    rows = _receipts(spark, sf_dir)
    for part in (F.col("title").rlike("^[a-z]"), ~F.col("title").rlike("^[a-z]")):
        receipts.append_receipts(rows.filter(part), path)
    return receipts.load_receipts(spark, path).select("receipt_id", "job_id", "company", "title", stamp("created_at"))


def _receipts(spark, sf_dir):
    names = X.companies(spark, sf_dir).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    named = X.jobs(spark, sf_dir).join(names, "company_id")
    return named.select(
        F.concat(F.lit("r"), F.substring_index("id", ":", -1)).alias("receipt_id"), F.col("id").alias("job_id"), "company", "title",
        F.col("verified_at").alias("created_at"),
    )


@query(
    "latest_receipts",
    f"{O.JOBS} SELECT 'r' || k AS receipt_id, {sql_stamp('verified_at', 'created_at')} FROM jobs ORDER BY verified_at DESC, 'r' || k DESC LIMIT 10",
)
def latest_receipts(spark, sf_dir):
    return status.latest_receipts(_receipts(spark, sf_dir)).select("receipt_id", stamp("created_at"))


# --- streams ------------------------------------------------------------------------------


@query(
    "stream_watch_matches",
    f"{_BOTH}, {_TOP} SELECT w.watch_id, m.id, m.rank, round({_MSCORE}, 6) AS score FROM watches w JOIN top m ON {_SAME} WHERE active",
)
def stream_watch_matches(spark, sf_dir):
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    store.write({"watches": X.watches(spark, sf_dir)})
    X.jobs(spark, sf_dir).write.parquet(f"{root}/postings")
    start_matching(
        store, f"{root}/postings", f"{root}/matches", f"{root}/checkpoint", lambda _: X.NOW, _ONCE
    ).awaitTermination()
    found = spark.read.parquet(f"{root}/matches")
    return found.select("watch_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("stream_lifecycle", registered_sql("lifecycle_spans"))
def stream_lifecycle(spark, sf_dir):
    """The crawl log in three batches: the middle of the month, then its beginning, and the rest with half of one more day."""
    root = shared_root(spark)
    store = StateStore(spark, f"{root}/state")
    log = X.crawl_log(spark, sf_dir)
    half = F.pmod(F.xxhash64("posting_id"), F.lit(2))
    third = F.when(F.dayofmonth("day") <= 10, 1).when(F.dayofmonth("day") < 20, 0).when(F.dayofmonth("day") == 20, 2 * half).otherwise(2)
    for part in range(3):
        log.filter(third == part).write.parquet(f"{root}/log/part={part}")
        start_lifecycle(store, f"{root}/log/*", f"{root}/checkpoint", _ONCE, files_per_batch=1000).awaitTermination()
    found = store.read("spans", SPANS)
    return found.select(*[F.col(c).cast("string") if c in ("live_from", "last_seen", "delisted_on") else c for c in found.columns])


# --- plug-ins -----------------------------------------------------------------------------


def _make_reader():
    """Reads the tags a posting lists; it cannot read shouted titles."""

    def read(posting: dict) -> dict:
        if posting["title"].endswith("."):
            raise ValueError("unreadable")
        listed = posting["description_raw"].removeprefix("We use ").split(". ", 1)[0]
        return {"skills": listed.split(", "), "remote_policy": "unknown"}

    return read


@query(
    "extract_plugin",
    f"{O.INGEST} SELECT id, CASE WHEN title LIKE '%.' THEN NULL ELSE array_to_string(skills, ',') END AS skills FROM feed",
)
def extract_plugin(spark, sf_dir):
    feed = accepted_feed(X.feed(spark, sf_dir), X.crawls(spark, sf_dir))
    found = extract_with(feed, _make_reader)
    return feed.select("id").join(found, "id", "left").select("id", joined(F.col("facts.skills"), "skills"))


def _make_model():
    read = _make_reader()
    return lambda posting: {**read(posting), "prompt_tokens": len(posting["title"]), "completion_tokens": 7}


@query(
    "extract_outcomes",
    f"""{O.TEXT_JOBS} SELECT id AS job_id, title NOT LIKE '%.' AS ok, CASE WHEN title LIKE '%.' THEN '' ELSE array_to_string(skills, ',') END AS skills,
  CASE WHEN title LIKE '%.' THEN 0 ELSE length(title) END AS prompt_tokens, CASE WHEN title LIKE '%.' THEN 'ValueError: unreadable' END AS error FROM jobs""",
)
def extract_outcomes(spark, sf_dir):
    rows = rebuild.collect_outcomes(X.jobs(spark, sf_dir, with_text=True), _make_model)
    return rows.select("job_id", "ok", joined(F.col("skills"), "skills"), "prompt_tokens", "error")


def _make_family_model():
    def label(posting: dict) -> dict:
        if posting["title"].endswith("."):
            raise ValueError("unreadable")
        said = (" DATA ", "sales", "wizard")[len(posting["title"]) % 3]
        return {"role_family": said, "prompt_tokens": len(posting["title"]), "completion_tokens": 3}

    return label


@query(
    "family_outcomes",
    f"""{O.JOBS} SELECT id AS job_id, title NOT LIKE '%.' AS ok, CASE WHEN title LIKE '%.' THEN NULL ELSE (['data','sales','other'])[length(title) % 3 + 1] END AS role_family,
  CASE WHEN title LIKE '%.' THEN 0 ELSE length(title) END AS prompt_tokens, CASE WHEN title LIKE '%.' THEN 0 ELSE 3 END AS completion_tokens,
  CASE WHEN title LIKE '%.' THEN 'ValueError: unreadable' END AS error FROM jobs""",
)
def family_outcomes(spark, sf_dir):
    rows = rebuild.collect_family_outcomes(X.jobs(spark, sf_dir), _make_family_model)
    return rows.select("job_id", "ok", "role_family", "prompt_tokens", "completion_tokens", "error")


# --- repositories -------------------------------------------------------------------------

_NAMES = "(['.py','.rs','.go','.ts','.TSX'])"
_TREE = f"""tree AS (SELECT o_orderkey AS k, '#f' || o_custkey % 50 AS fingerprint, CASE WHEN o_orderkey % 6 < 5 THEN 'r' || o_orderkey % 6 END AS repo,
  CASE WHEN o_orderkey % 11 < 5 THEN 'm' || o_orderkey || {_NAMES}[o_orderkey % 11 + 1]
    ELSE (['package.json','Dockerfile','main.tf','readme','.bashrc','Cargo.toml'])[o_orderkey % 11 - 4] END AS name,
  o_orderkey % 9 = 4 AS skipped, o_orderkey % 11 AS kind, (['express','graphql','aws-sdk','kafka'])[o_orderkey % 4 + 1] AS dep FROM orders),
files AS (SELECT * FROM tree WHERE NOT skipped),
tagged AS (SELECT *, (['python','rust','go','typescript','typescript'])[kind + 1] AS language,
  CASE kind WHEN 5 THEN ['react', CASE dep WHEN 'express' THEN 'node' WHEN 'aws-sdk' THEN 'aws' ELSE dep END] WHEN 6 THEN ['docker'] WHEN 7 THEN ['terraform']
    WHEN 10 THEN ['rust','redis'] ELSE [] END AS tags FROM files)"""


def _files(spark, sf_dir):
    """Every order as a file of some caller's repositories."""
    k = F.col("o_orderkey")
    kind = k % 11
    name = F.when(
        kind < 5, F.concat(F.lit("m"), k, X._pick([".py", ".rs", ".go", ".ts", ".TSX"], kind))
    ).otherwise(X._pick(["package.json", "Dockerfile", "main.tf", "readme", ".bashrc", "Cargo.toml"], kind - 5))
    folder = F.when(k % 9 == 4, F.lit("node_modules/")).when(k % 9 == 5, F.lit("src/")).otherwise(F.lit(""))
    repo = F.when(k % 6 < 5, F.concat(F.lit("r"), k % 6, F.lit("/"))).otherwise(F.lit(""))
    dep = X._pick(["express", "graphql", "aws-sdk", "kafka"], k % 4)
    text = F.when(kind == 5, F.concat(F.lit('{"dependencies": {"React": 1, "'), dep, F.lit('": 2}}'))).when(
        kind == 10, F.lit("[dependencies]\ntokio = 1\nredis = 2")
    )
    paths = X.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("#f"), F.col("o_custkey") % 50).alias("fingerprint"),
        F.concat(F.lit("/scan/"), repo, folder, name).alias("path"),
        text.alias("text"),
    )
    return repo_files.files_of(paths, "/scan")


@query(
    "repo_files",
    f"""WITH {_TREE} SELECT fingerprint, CASE WHEN repo IS NULL AND k % 9 = 5 THEN 'src' ELSE repo END AS repo, name,
  CASE WHEN kind < 5 THEN lower({_NAMES}[kind + 1]) ELSE (['.json','','.tf','','','.toml'])[kind - 4] END AS suffix FROM files""",
)
def repo_file_table(spark, sf_dir):
    return _files(spark, sf_dir).select("fingerprint", "repo", "name", "suffix")


@query("file_language", f"WITH {_TREE} SELECT fingerprint, name, language FROM tagged")
def file_languages(spark, sf_dir):
    return _files(spark, sf_dir).select("fingerprint", "name", S.file_language(F.col("name")).alias("language"))


@query("manifest_skills", f"WITH {_TREE} SELECT fingerprint, name, array_to_string(list_sort(tags), ',') AS skills FROM tagged")
def manifest_tags(spark, sf_dir):
    return _files(spark, sf_dir).select("fingerprint", "name", sorted_tags(S.manifest_skills(F.col("name"), F.col("text")), "skills"))


_SHARES = """shares AS (SELECT fingerprint, language, count(*) AS files, round(count(*) / sum(count(*)) OVER (PARTITION BY fingerprint) * 100.0::DOUBLE, 1) AS pct
  FROM tagged WHERE language IS NOT NULL GROUP BY 1, 2)"""


@query("language_share", f"WITH {_TREE}, {_SHARES} SELECT fingerprint, language, files, pct FROM shares")
def language_share(spark, sf_dir):
    return fingerprint.language_share(_files(spark, sf_dir))


@query(
    "top_languages",
    f"WITH {_TREE}, {_SHARES} SELECT fingerprint, language, row_number() OVER (PARTITION BY fingerprint ORDER BY pct DESC, language) AS rank FROM shares QUALIFY rank <= 4",
)
def top_languages(spark, sf_dir):
    best = status.top_languages(fingerprint.language_share(_files(spark, sf_dir)))
    return best.select("fingerprint", "language", F.col("rank").cast("bigint").alias("rank"))


@query(
    "fingerprint_skills",
    f"""WITH {_TREE}, {_SHARES}, t AS (SELECT fingerprint, language AS tag FROM shares WHERE pct >= 5 UNION SELECT fingerprint, unnest(tags) FROM tagged),
r AS (SELECT fingerprint, greatest(count(DISTINCT CASE WHEN repo IS NULL AND k % 9 = 5 THEN 'src' ELSE repo END), 1) AS repos FROM tagged GROUP BY 1)
SELECT fingerprint AS id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS skills, any_value(repos) AS repos_scanned FROM t JOIN r USING (fingerprint) GROUP BY 1""",
)
def fingerprint_skills(spark, sf_dir):
    found = fingerprint.fingerprints(_files(spark, sf_dir))
    return found.select("id", joined(F.col("skills"), "skills"), "repos_scanned")
