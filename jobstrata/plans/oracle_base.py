"""The projection of :mod:`jobstrata.plans.fixtures` again, in DuckDB SQL, as shared CTEs.

Written from the rules, not generated from the Spark plans, so that the two check each other.
"""

NOW = "TIMESTAMP '2001-08-15 00:00:00'"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_WORDS = "['python','rust','go','k8s','sql','aws','llm','rag','cuda','java']"
_LOCATIONS = (
    "['Remote','Remote - EMEA','Remote - Germany','Berlin','Remote, US','Remote - Japan',NULL,'Anywhere']"
)


def iif(*pairs: str, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(pairs[::2], pairs[1::2]))
    return f"CASE {arms} ELSE {default} END"


def days_between(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 86400000000.0)"


def ghost(relists: str, start: str, end: str = NOW) -> str:
    over = f"greatest(0.0::DOUBLE, {days_between(start, end)} - 45.0::DOUBLE)"
    return (
        f"least(1.0::DOUBLE, greatest(0, {relists}) * 0.15::DOUBLE"
        f" + {over} / 90.0::DOUBLE * 0.5::DOUBLE)"
    )


def fresh(verified: str) -> str:
    age = days_between(verified, NOW)
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - {age} / 30.0::DOUBLE))"


def normalized(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '{SPACE}+', ' ', 'g'))"


def normalized_title(text: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def hashed(title: str, description: str) -> str:
    return f"sha256({normalized(title)} || chr(10) || {normalized(description)})"


def canonical(vendor: str, tenant: str, job: str) -> str:
    return iif(
        f"{vendor} = 'greenhouse'",
        f"'https://boards.greenhouse.io/embed/job_app?for=' || {tenant} || '&token=' || {job}",
        f"{vendor} = 'lever'",
        f"'https://jobs.lever.co/' || {tenant} || '/' || {job}",
        f"{vendor} = 'ashby'",
        f"'https://jobs.ashbyhq.com/' || {tenant} || '/' || {job}",
    )


def careers(vendor: str, tenant: str) -> str:
    return iif(
        f"{vendor} = 'greenhouse'", f"'https://job-boards.greenhouse.io/' || {tenant}",
        f"{vendor} = 'lever'", f"'https://jobs.lever.co/' || {tenant}",
        f"{vendor} = 'ashby'", f"'https://jobs.ashbyhq.com/' || {tenant}",
    )


_VENDOR = "(['greenhouse','lever','ashby'])[(company_no % 3) + 1]"
_TENANT = "('t' || company_no)"

COMPANIES = f"""companies AS (
  SELECT id, name, ats_vendor, ats_tenant, {careers('ats_vendor', 'ats_tenant')} AS careers_url,
         false AS verified, last_crawled_at, s_suppkey
  FROM (SELECT s_suppkey, 'c' || s_suppkey AS id, s_name AS name,
               (['greenhouse','lever','ashby'])[(s_suppkey % 3) + 1] AS ats_vendor,
               't' || s_suppkey AS ats_tenant,
               CASE WHEN s_suppkey % 10 <> 9 THEN {NOW} - to_hours(CAST(s_suppkey % 40 AS INTEGER)) END AS last_crawled_at
        FROM supplier))"""

_RAW = f"""raw AS (
  SELECT o_orderkey AS k, o_custkey % (SELECT count(*) FROM supplier) AS company_no, o_orderstatus AS status,
         o_totalprice AS price, o_orderdate AS dated, o_orderpriority AS priority, p_name,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'remote' WHEN o_orderpriority = '3-MEDIUM' THEN 'hybrid'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'onsite' ELSE 'unknown' END AS remote_policy,
         o_orderkey % (SELECT count(*) FROM documents) AS doc_no
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""

_SHAPED = f"""shaped AS (
  SELECT *, 'c' || company_no AS company_id, CAST(k AS VARCHAR) AS ats_job_id, {_VENDOR} AS vendor, {_TENANT} AS tenant,
    'c' || company_no || ':' || k AS id,
    CASE k % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '.' ELSE replace(p_name, ' ', ' - ') END AS title,
    list_sort(list_distinct([({_WORDS})[k % 10 + 1], ({_WORDS})[(k // 10) % 10 + 1], ({_WORDS})[(k // 7) % 10 + 1]])) AS skills,
    CASE WHEN k % 4 <> 0 THEN CAST(floor(price) AS INTEGER) END AS salary_min,
    CASE WHEN k % 4 > 1 THEN CAST(floor(price * 1.25::DOUBLE) AS INTEGER) END AS salary_max,
    CASE WHEN k % 4 <> 0 THEN (['USD','EUR','GBP'])[k % 3 + 1] END AS salary_currency,
    ({_LOCATIONS})[k % 8 + 1] AS location,
    (['engineering','data','sales','ops',NULL])[k % 5 + 1] AS role_family,
    CASE WHEN k % 10 <> 0 THEN dated END AS posted_at,
    dated + to_days(CAST(k % 10 AS INTEGER)) AS first_seen_at,
    CAST(k % 4 AS INTEGER) AS relist_count,
    CASE WHEN status = 'F' OR k % 6 = 1 THEN least(dated + to_days(60), {NOW} - to_days(1)) END AS delisted_at,
    CASE WHEN k % 2 = 0 AND remote_policy <> 'unknown' THEN remote_policy END AS workplace,
    (k % 7 <> 0 OR k % 9 = 8) AS in_feed, k % 9 <> 8 AS in_state
  FROM raw)"""

_POSTINGS = f"""postings AS (
  SELECT *, greatest(first_seen_at, {NOW} - to_days(CAST(k % 45 AS INTEGER)) - to_minutes(CAST(k % 1440 AS INTEGER)) - to_seconds(7)) AS verified_at,
    CASE k % 5
      WHEN 0 THEN CASE WHEN vendor = 'greenhouse' THEN 'https://job-boards.greenhouse.io/' || tenant || '/jobs/' || k
                       ELSE {canonical('vendor', 'tenant', 'k')} END
      WHEN 1 THEN 'https://careers.example.com/job?gh_jid=' || k
      WHEN 2 THEN {careers('vendor', 'tenant')}
      WHEN 3 THEN {canonical('vendor', 'tenant', 'k')} END AS vendor_url,
    {ghost('relist_count', 'coalesce(posted_at, first_seen_at)')} AS ghost_score,
    CASE WHEN vendor = 'greenhouse' THEN first_seen_at ELSE posted_at END AS updated_at
  FROM shaped)"""

_TEXT = """described AS (
  SELECT postings.*, 'We use ' || array_to_string(skills, ', ') || '. '
    || (['This role is fully remote. ','Work is hybrid. ','Work is on-site. ','In-office days vary. ','100% remote team. ','',''])[k % 7 + 1]
    || (['','','Pay $120,000 - $180,000. ','Comp: $90k–$140k. '])[k % 4 + 1] || documents.text AS description_raw
  FROM postings JOIN documents ON doc_id = doc_no)"""


def _jobs(source: str, text: bool, where: str = "") -> str:
    description = "description_raw" if text else "CAST(NULL AS VARCHAR)"
    content = hashed("title", "description_raw") if text else "CAST(NULL AS VARCHAR)"
    return f"""
  SELECT k, id, company_id, title, {description} AS description_raw, skills, role_family, remote_policy, salary_min, salary_max,
    salary_currency, false AS salary_inferred, location, posted_at, updated_at, first_seen_at, verified_at, delisted_at,
    relist_count, ghost_score, CAST(NULL AS INTEGER) AS response_sla_days, 'ats_public_api' AS source, vendor, tenant, ats_job_id,
    coalesce(vendor_url, {canonical('vendor', 'tenant', 'k')}) AS apply_channel, {content} AS content_hash,
    CASE WHEN k % 3 = 0 THEN 'model' ELSE 'heuristic' END AS extraction_source,
    CASE WHEN k % 3 = 0 THEN list_reverse(skills) ELSE [] END AS skills_fallback,
    CASE WHEN k % 3 = 0 THEN remote_policy END AS remote_policy_fallback,
    CASE WHEN k % 3 = 0 THEN salary_min END AS salary_min_fallback,
    CASE WHEN k % 3 = 0 THEN salary_max END AS salary_max_fallback,
    CASE WHEN k % 3 = 0 THEN salary_currency END AS salary_currency_fallback
  FROM {source} {where}"""


_ROWS = f"{COMPANIES}, {_RAW}, {_SHAPED}, {_POSTINGS}"

# The whole index without the long text, and with it.
JOBS = f"WITH {_ROWS}, jobs AS ({_jobs('postings', False)})"
TEXT_JOBS = f"WITH {_ROWS}, {_TEXT}, jobs AS ({_jobs('described', True)})"
# Rows of the projection with their helper columns, and with the text.
POSTINGS = f"WITH {_ROWS}"
DESCRIBED = f"WITH {_ROWS}, {_TEXT}"


def trusted(vendor: str, job: str, url: str) -> str:
    hosts = iif(
        f"{vendor} = 'greenhouse'", "['boards.greenhouse.io','job-boards.greenhouse.io']",
        f"{vendor} = 'lever'", "['jobs.lever.co']", f"{vendor} = 'ashby'", "['jobs.ashbyhq.com']",
    )
    return (
        f"(list_contains({hosts}, {authority(url)}) AND "
        f"contains(split_part(split_part(regexp_replace(coalesce({url}, ''), '^[a-z]*://[^/?#]*', ''), '?', 1), '#', 1), {job}))"
    )


def authority(url: str) -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '^[a-z]*://([^/?#]*)', 1))"


def resolved(vendor: str, tenant: str, job: str, url: str) -> str:
    return f"CASE WHEN {trusted(vendor, job, url)} THEN {url} ELSE {canonical(vendor, tenant, job)} END"


_CRAWLS = """crawls AS (
  SELECT 'c' || s_suppkey AS company_id, s_suppkey % 13 <> 0 AS ok,
         CASE WHEN s_suppkey % 13 = 0 THEN 404 ELSE 200 END AS status,
         CASE WHEN s_suppkey % 13 = 0 THEN 'non-200' END AS error FROM supplier)"""

_BARE_FEED = f"""
  SELECT p.* EXCLUDE (description_raw, salary_min, salary_max, salary_currency), k AS feed_pos,
    description_raw || CASE WHEN k % 5 = 0 THEN ' Updated.' ELSE '' END AS description_raw,
    {resolved('vendor', 'tenant', 'ats_job_id', 'vendor_url')} AS apply_channel,
    coalesce(workplace, CASE WHEN contains(lower(location), 'remote') THEN 'remote' END, 'unknown') AS remote_hint,
    CASE WHEN vendor <> 'greenhouse' THEN salary_min END AS salary_min,
    CASE WHEN vendor <> 'greenhouse' THEN salary_max END AS salary_max,
    CASE WHEN vendor <> 'greenhouse' THEN salary_currency END AS salary_currency
  FROM described p JOIN crawls USING (company_id) WHERE in_feed AND ok"""

# The state before the crawl, the accepted feed with its hash, and the relist result.
INGEST = f"""WITH {_ROWS}, {_TEXT}, {_CRAWLS},
state AS ({_jobs('described', True, 'WHERE in_state')}),
bare_feed AS ({_BARE_FEED}),
feed AS (SELECT *, {hashed('title', 'description_raw')} AS content_hash, {normalized_title('title')} AS norm FROM bare_feed),
siblings AS (
  SELECT s.*, {normalized_title('s.title')} AS norm, f.feed_pos AS back_pos
  FROM state s LEFT JOIN feed f USING (id) WHERE s.delisted_at IS NOT NULL),
relisted AS (
  SELECT n.id, s.id AS sibling_id, s.relist_count + 1 AS relist_count, s.first_seen_at
  FROM feed n ANTI JOIN state USING (id)
  JOIN siblings s ON s.company_id = n.company_id AND s.norm = n.norm AND s.norm <> ''
       AND (s.back_pos IS NULL OR s.back_pos > n.feed_pos)
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY s.delisted_at DESC, s.id) = 1)"""
