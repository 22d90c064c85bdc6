"""Text, skills, pay and link functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions import extraction as E
from jobstrata.functions import pay, scoring, skills, summary, text, urls
from jobstrata.functions.remote import remote_scope, resolve_remote
from jobstrata.plans import fixtures as X
from jobstrata.plans import oracle_base as O
from jobstrata.plans.registry import joined, query, sql_stamp, sql_tags, stamp
from jobstrata.plans.search_plans import scope_sql

# --- text -----------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {O.normalized('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("normalize_title", f"SELECT doc_id, {O.normalized_title('text')} AS norm FROM documents")
def normalize_title(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("norm"))


@query("content_hash", f"{O.TEXT_JOBS} SELECT id, content_hash FROM jobs")
def content_hash(spark, sf_dir):
    return X.jobs(spark, sf_dir, with_text=True).select("id", "content_hash")


def _markup_sql(decode) -> str:
    step = decode("coalesce(html, '')")
    for tag, to in (
        ("</p>", "chr(10) || chr(10)"), ("<br>", "chr(10)"), ("<br/>", "chr(10)"), ("<br />", "chr(10)"),
        ("</li>", "chr(10)"), ("<li>", "'• '"),
    ):
        step = f"replace({step}, '{tag}', {to})"
    step = decode(f"regexp_replace({step}, '<[^>]+>', '', 'g')")
    step = rf"regexp_replace({step}, '[ \t\r\f\x0b]+', ' ', 'g')"
    step = rf"regexp_replace({step}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({step}, '^{O.SPACE}+', ''), '{O.SPACE}+$', '')"


def _decode_sql(extra: dict[str, str]):
    def decode(expr: str) -> str:
        table = {**extra, "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#39;": "chr(39)", "&nbsp;": "chr(160)"}
        for entity, to in {**table, "&amp;": "'&'"}.items():
            expr = f"replace({expr}, '{entity}', {to})"
        return expr

    return decode


# The pages use two entities beyond the basic ones.
@query(
    "html_to_text",
    f"SELECT page_id, {_markup_sql(_decode_sql({'&copy;': 'chr(169)', '&middot;': 'chr(183)'}))} AS plain FROM pages",
)
def html_to_text(spark, sf_dir):
    return text.with_plain_text(X.table(spark, sf_dir, "pages"), "html", "plain").select("page_id", "plain")


@query("html_to_text_basic", f"SELECT page_id, {_markup_sql(_decode_sql({}))} AS plain FROM pages")
def html_to_text_basic(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return text.with_plain_text(pages, "html", "plain", decode=text.unescape_basic).select("page_id", "plain")


@query(
    "parse_dates",
    f"""SELECT event_id, {sql_stamp('''CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - to_hours(2)
  WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts) END''', 'iso')},
  {sql_stamp("CASE WHEN event_id % 7 < 5 THEN date_trunc('second', ts) END", 'epoch')} FROM events""",
)
def parse_dates(spark, sf_dir):
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    iso = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(kind == 4, F.concat(F.lit("on "), F.date_format(ts, "yyyy-MM-dd")))
        .otherwise(F.lit(""))
    )
    other = F.col("event_id") % 7
    millis = (
        F.when(other < 5, (F.unix_seconds(ts) * 1000).cast("string")).when(other == 5, "0").otherwise("soon")
    )
    return (
        X.table(spark, sf_dir, "events")
        .select("event_id", text.parse_iso(iso).alias("iso"), text.parse_epoch_ms(millis).alias("epoch"))
        .select("event_id", stamp("iso"), stamp("epoch"))
    )


@query(
    "prompt_text",
    f"""{O.TEXT_JOBS} SELECT id, 'Title: ' || title || chr(10) || 'Location: ' || coalesce(location, 'n/a') || chr(10) || chr(10)
  || 'Description:' || chr(10) || substr(description_raw, 1, 4000) AS prompt,
  length(substr(description_raw, 1, 2500)) AS family_chars FROM jobs""",
)
def prompt_text(spark, sf_dir):
    title, place, body = F.col("title"), F.col("location"), F.col("description_raw")
    head = F.char_length(text.prompt_text(title, place, F.lit(""), 2500))
    return X.jobs(spark, sf_dir, with_text=True).select(
        "id",
        text.prompt_text(title, place, body).alias("prompt"),
        (F.char_length(text.prompt_text(title, place, body, 2500)) - head).alias("family_chars"),
    )


@query(
    "key_points",
    """SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)),
    lambda l: trim(l, ' •-' || chr(9))), lambda l: length(l) >= 25)[1:3],
    lambda l: CASE WHEN length(l) > 100 THEN substr(l, 1, 100) || '…' ELSE l END), '|') AS points FROM documents""",
)
def key_points(spark, sf_dir):
    points = F.array_join(text.key_points(F.col("text")), "|")
    return X.table(spark, sf_dir, "documents").select("doc_id", points.alias("points"))


# --- keys and links ---------------------------------------------------------------


@query(
    "job_key",
    f"{O.POSTINGS} SELECT company_id || ':' || k || ':x' AS job_id, CAST(k AS VARCHAR) || ':x' AS ats_job_id FROM postings",
)
def job_key(spark, sf_dir):
    key = urls.job_key(F.col("company_id"), F.concat("ats_job_id", F.lit(":x")))
    return X.postings(spark, sf_dir).select(key.alias("job_id")).withColumn("ats_job_id", urls.ats_job_id(F.col("job_id")))


_ENDPOINT = O.iif(
    "ats_vendor = 'greenhouse'", "'https://boards-api.greenhouse.io/v1/boards/' || ats_tenant || '/jobs?content=true'",
    "ats_vendor = 'lever'", "'https://api.lever.co/v0/postings/' || ats_tenant || '?mode=json'",
    "ats_vendor = 'ashby'", "'https://api.ashbyhq.com/posting-api/job-board/' || ats_tenant || '?includeCompensation=true'",
)


@query("careers_urls", f"{O.POSTINGS} SELECT id, careers_url, {_ENDPOINT} AS endpoint FROM companies")
def careers_urls(spark, sf_dir):
    vendor, tenant = F.col("ats_vendor"), F.col("ats_tenant")
    return X.companies(spark, sf_dir).select(
        "id", urls.careers_url(vendor, tenant).alias("careers_url"), urls.endpoint(vendor, tenant).alias("endpoint")
    )


@query("canonical_url", f"{O.POSTINGS} SELECT id, {O.canonical('vendor', 'tenant', 'k')} AS url FROM postings")
def canonical_url(spark, sf_dir):
    url = urls.canonical_apply_url(F.col("vendor"), F.col("tenant"), F.col("ats_job_id"))
    return X.postings(spark, sf_dir).select("id", url.alias("url"))


_TRUSTED = O.trusted("vendor", "ats_job_id", "vendor_url")


@query(
    "apply_resolution",
    f"""{O.POSTINGS} SELECT id, {O.resolved('vendor', 'tenant', 'ats_job_id', 'vendor_url')} AS url,
  NOT {_TRUSTED} AS used_fallback, {O.authority('vendor_url')} NOT IN ('', 'boards.greenhouse.io', 'job-boards.greenhouse.io',
    'jobs.lever.co', 'jobs.ashbyhq.com') AS is_embed FROM postings""",
)
def apply_resolution(spark, sf_dir):
    result = urls.resolve_apply(F.col("vendor"), F.col("tenant"), F.col("ats_job_id"), F.col("vendor_url"))
    return X.postings(spark, sf_dir).select("id", result.alias("r")).select("id", "r.url", "r.used_fallback", "r.is_embed")


# --- skills -----------------------------------------------------------------------

_ALIASES = {
    "kubernetes": "k8s", "cpp": "c++", "c/c++": "c++", "golang": "go", "ts": "typescript", "postgresql": "postgres",
    "postgre": "postgres", "node.js": "node", "nodejs": "node", "retrieval-augmented generation": "rag",
    "retrieval augmented generation": "rag", "large language model": "llm", "large language models": "llm", "llms": "llm",
    "natural language processing": "nlp", "machine learning": "ml", "google cloud": "gcp", "google cloud platform": "gcp",
    "amazon web services": "aws", "distributed systems": "distributed-systems", "distributed system": "distributed-systems",
    "vector database": "vector-db", "vector databases": "vector-db", "vector db": "vector-db", "embeddings": "vector-db",
    "embedding": "vector-db", "gpus": "gpu", "tf": "tensorflow",
}
_FREE_FORM = ["Kubernetes ", " GoLang", "LLMs", "", "Machine Learning", "rust", "K8S", "Embeddings", "Go", "cpp"]
_FREE_SQL = "[" + ", ".join(f"'{t}'" for t in _FREE_FORM) + "]"
_LONG_ALIASES = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ALIASES.items()) + " ELSE t END"


def _in_order(expr: str) -> str:
    """Distinct values of a list in order of first occurrence."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_CANONICAL_TAGS = (
    "list_filter(list_transform(list_transform(tags, lambda t: lower(trim(t))), lambda t: "
    f"{_LONG_ALIASES}), lambda t: t <> '')"
)


@query(
    "canonicalize_skills",
    f"""WITH o AS (SELECT o_orderkey AS k, list_concat([({_FREE_SQL})[o_orderkey % 10 + 1], ({_FREE_SQL})[(o_orderkey // 10) % 10 + 1],
  ({_FREE_SQL})[(o_orderkey // 100) % 10 + 1]], string_split(o_orderpriority, '-')) AS tags FROM orders),
c AS (SELECT k, {_CANONICAL_TAGS} AS tags FROM o) SELECT k, {sql_tags(_in_order('tags'), 'skills')} FROM c""",
)
def canonicalize_skills(spark, sf_dir):
    picks = [X._pick(_FREE_FORM, F.expr(f"(o_orderkey div {d}) % 10")) for d in (1, 10, 100)]
    tags = F.concat(F.array(*picks), F.split("o_orderpriority", "-"))
    return X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), joined(skills.canonical_skills(tags), "skills")
    )


def _vocabulary_sql(source: str) -> str:
    """Tags found by the vocabulary; word boundaries written without look-around."""
    arms = []
    for tag, patterns in C.SKILL_VOCABULARY.items():
        tests = []
        for p in patterns:
            if p.startswith(r"\b"):
                p = rf"(^|[^\p{{L}}\p{{N}}_]){p[2:-2]}($|[^\p{{L}}\p{{N}}_])"
            tests.append(f"regexp_matches({source}, '(?i){p}')")
        arms.append(f"CASE WHEN {' OR '.join(tests)} THEN '{tag}' END")
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)[1:12]"


_BODY = "(title || chr(10) || description_raw)"


@query("extract_skills", f"{O.TEXT_JOBS} SELECT id, {sql_tags(_vocabulary_sql(_BODY), 'skills')} FROM jobs")
def extract_skills(spark, sf_dir):
    body = F.concat_ws("\n", "title", "description_raw")
    rows = X.jobs(spark, sf_dir, with_text=True).select("id", skills.lowered_text(body).alias("lowered"))
    return rows.select("id", joined(skills.skills_in(F.col("lowered")), "skills"))


# A caller's own vocabulary: literals, classes, alternatives, repetitions.
_CUSTOM = {
    "staff": ["team|crew"], "pay": [r"\$[0-9]+"], "office": ["in-office", "on-?site"], "stack": ["RUST", "k8s"], "double": ["([a-z])oo"],
    "ending": ["ing[ .,]"], "distant": ["fully remote", "100% remote"], "never": ["zzzzzz+"],
}


def _custom_sql(body: str) -> str:
    def found(patterns: list[str]) -> str:
        return " OR ".join(f"regexp_matches({body}, '(?i){p}')" for p in patterns)

    tags = ", ".join(f"CASE WHEN {found(patterns)} THEN '{tag}' END" for tag, patterns in _CUSTOM.items())
    return f"list_filter([{tags}], lambda t: t IS NOT NULL)[:5]"


@query("extract_skills_custom", f"{O.TEXT_JOBS} SELECT id, {sql_tags(_custom_sql(_BODY), 'skills')} FROM jobs")
def extract_skills_custom(spark, sf_dir):
    body = F.concat_ws("\n", "title", "description_raw")
    rows = X.jobs(spark, sf_dir, with_text=True).select("id", skills.lowered_text(body).alias("lowered"))
    return rows.select("id", joined(skills.skills_in(F.col("lowered"), _CUSTOM, 5), "skills"))


@query(
    "skill_list_parse",
    """WITH f AS (SELECT c_custkey AS c, CASE c_custkey % 4 WHEN 0 THEN ' Auto ' WHEN 1 THEN 'Rust, ' || c_mktsegment || ' ,,K8S'
  WHEN 2 THEN '' ELSE c_mktsegment END AS arg FROM customer)
SELECT c, CASE WHEN lower(trim(arg)) = 'auto' THEN 'go,sql' WHEN arg <> '' THEN
  array_to_string(list_filter(list_transform(string_split(arg, ','), lambda s: lower(trim(s))), lambda s: s <> ''), ',') END AS skills FROM f""",
)
def skill_list_parse(spark, sf_dir):
    c, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    arg = (
        F.when(kind == 0, F.lit(" Auto "))
        .when(kind == 1, F.concat(F.lit("Rust, "), "c_mktsegment", F.lit(" ,,K8S")))
        .when(kind == 2, F.lit(""))
        .otherwise(F.col("c_mktsegment"))
    )
    own = X.table(spark, sf_dir, "customer").select(
        c.alias("c"), F.array(F.lit("go"), F.lit("sql")).alias("own_skills")
    )
    asked = X.table(spark, sf_dir, "customer").select(c.alias("c"), arg.alias("arg"))
    chosen = F.when(skills.is_auto_list(F.col("arg")), F.col("own_skills")).otherwise(
        skills.parse_skill_list(F.col("arg"))
    )
    return asked.join(own, "c", "left").select("c", joined(chosen, "skills"))


# --- pay --------------------------------------------------------------------------

_CUR = r"(\$|usd|eur|€|gbp|£)?"
_AMT = r"(\d{2,3}(?:[,\.]\d{3})?)"
_RANGE = f"(?i){_CUR}{O.SPACE}*{_AMT}{O.SPACE}*(k)?{O.SPACE}*(?:-|–|—|to){O.SPACE}*{_CUR}{O.SPACE}*{_AMT}{O.SPACE}*(k)?"


def _amount_sql(number: int, thousands: int) -> str:
    value = f"CAST(replace(regexp_extract(m, '{_RANGE}', {number}), ',', '') AS DOUBLE)"
    return f"CAST(floor({value} * CASE WHEN regexp_extract(m, '{_RANGE}', {thousands}) <> '' THEN 1000 ELSE 1 END) AS INTEGER)"


def _range_sql(source: str) -> str:
    """The first plausible range of a text as a struct."""
    symbol = f"lower(CASE WHEN regexp_extract(m, '{_RANGE}', 1) <> '' THEN regexp_extract(m, '{_RANGE}', 1) ELSE regexp_extract(m, '{_RANGE}', 4) END)"
    code = f"CASE {symbol} WHEN '$' THEN 'USD' WHEN 'usd' THEN 'USD' WHEN 'eur' THEN 'EUR' WHEN '€' THEN 'EUR' WHEN 'gbp' THEN 'GBP' WHEN '£' THEN 'GBP' END"
    read = f"{{'lo': {_amount_sql(2, 3)}, 'hi': {_amount_sql(5, 6)}, 'cur': {code}}}"
    found = f"list_transform(regexp_extract_all({source}, '{_RANGE}', 0), lambda m: {read})"
    return f"list_filter({found}, lambda r: r.hi >= r.lo AND r.hi >= 20000 AND r.hi <= 5000000)[1]"


@query(
    "salary_from_text",
    f"""{O.TEXT_JOBS}, r AS (SELECT id, {_range_sql('description_raw')} AS r FROM jobs)
SELECT id, r.lo AS salary_min, r.hi AS salary_max, r.cur AS salary_currency FROM r""",
)
def salary_from_text(spark, sf_dir):
    found = X.jobs(spark, sf_dir, with_text=True).select("id", pay.pay_from_text(F.col("description_raw")).alias("p"))
    return found.select(
        "id", F.col("p.min").alias("salary_min"), F.col("p.max").alias("salary_max"), F.col("p.currency").alias("salary_currency")
    )


@query(
    "salary_units",
    """SELECT o_orderkey AS k, CAST(CASE o_orderkey % 9 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) % 1000 * 1000
  WHEN 2 THEN floor(o_totalprice) % 100 * 10000 WHEN 3 THEN floor(o_totalprice) % 100 * 10000 WHEN 4 THEN 1500000
  WHEN 5 THEN floor(o_totalprice) % 1000 * 1000 + 250 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE floor(o_totalprice) % 10 * 1000 END AS BIGINT) AS amount FROM orders""",
)
def salary_units(spark, sf_dir):
    n, kind = F.floor("o_totalprice"), F.col("o_orderkey") % 9
    cast = lambda c: c.cast("string")
    arg = (
        F.when(kind == 0, cast(n))
        .when(kind == 1, F.concat(cast(n % 1000), F.lit("K")))
        .when(kind == 2, F.concat(F.lit(" "), cast(n % 100), F.lit(" w ")))
        .when(kind == 3, F.concat(cast(n % 100), F.lit("万")))
        .when(kind == 4, F.lit("1.5m"))
        .when(kind == 5, F.concat(cast(n % 1000), F.lit(",250")))
        .when(kind == 6, F.lit("lots"))
        .when(kind == 7, F.concat(cast(n), F.lit("x")))
        .otherwise(F.concat(cast(n % 10), F.lit("，000")))
    )
    return X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), pay.parse_salary_argument(arg).alias("amount")
    )


# --- derived facts ----------------------------------------------------------------

_WORD_START, _WORD_END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def remote_sql(hint: str, place: str, source: str) -> str:
    def said(pattern: str) -> str:
        return f"regexp_matches({source}, '{_WORD_START}({pattern}){_WORD_END}')"

    return O.iif(
        f"{hint} IN ('remote','hybrid','onsite')", hint,
        said("fully remote|100% remote|remote[- ]first"), "'remote'",
        said("hybrid"), "'hybrid'",
        said("on[- ]?site|in[- ]?office"), "'onsite'",
        f"contains(lower(coalesce({place}, '')), 'remote')", "'remote'",
        default="'unknown'",
    )


@query("resolve_remote", f"{O.DESCRIBED} SELECT id, {remote_sql('workplace', 'location', _BODY)} AS remote_policy FROM described")
def resolve_remotes(spark, sf_dir):
    body = F.concat_ws("\n", "title", "description_raw")
    rows = X.postings(spark, sf_dir, with_text=True).select("id", "workplace", "location", body.alias("body"))
    policy = resolve_remote(F.col("workplace"), F.col("location"), F.col("body"))
    return rows.select("id", policy.alias("remote_policy"))


def facts_sql(source: str) -> str:
    """id plus the heuristic facts of feed rows, without their sorting."""
    return f"""SELECT id, {_vocabulary_sql(_BODY)} AS f_skills, {remote_sql('remote_hint', 'location', _BODY)} AS f_remote,
  CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN {_range_sql('description_raw')}
    ELSE {{'lo': salary_min, 'hi': salary_max, 'cur': salary_currency}} END AS f_pay FROM {source}"""


@query(
    "extract_heuristic",
    f"""{O.INGEST}, facts AS ({facts_sql('feed')}) SELECT id, {sql_tags('f_skills', 'skills')}, f_remote AS remote_policy,
  f_pay.lo AS salary_min, f_pay.hi AS salary_max, f_pay.cur AS salary_currency FROM facts""",
)
def extract_heuristic(spark, sf_dir):
    feed = X.feed(spark, sf_dir)
    valid = X.crawls(spark, sf_dir).filter("ok").select("company_id")
    read = E.with_heuristic_facts(feed.join(valid, "company_id", "left_semi"))
    return read.select(F.concat_ws(":", "company_id", "ats_job_id").alias("id"), "facts").select(
        "id", joined(F.col("facts.skills"), "skills"), "facts.remote_policy", "facts.salary_min",
        "facts.salary_max", "facts.salary_currency",
    )



def _replies(spark, sf_dir):
    """What a model answered about each posting: JSON, sometimes prose, with free-form tags."""
    k = F.col("k")
    tags = F.array(X._pick(_FREE_FORM, k % 10), X._pick(_FREE_FORM, F.expr("(k div 10) % 10")), F.lit("  "))
    reply = F.to_json(
        F.struct(
            tags.alias("skills"),
            X._pick(["remote", "hybrid", "moon", None], k % 4).alias("remote_policy"),
            F.when(k % 2 == 0, F.lit(1000)).alias("salary_min"),
            F.when(k % 2 == 0, F.lit(2000)).alias("salary_max"),
            F.when(k % 2 == 0, F.lit("CHF")).alias("salary_currency"),
        )
    )
    return X.postings(spark, sf_dir).withColumn("reply", F.when(k % 13 == 0, F.lit("sorry")).otherwise(reply))


_MODEL_SQL = f"""m AS (SELECT *, k % 13 <> 0 AS readable, [({_FREE_SQL})[k % 10 + 1], ({_FREE_SQL})[(k // 10) % 10 + 1], '  '] AS tags FROM postings),
mc AS (SELECT *, {_CANONICAL_TAGS} AS ctags FROM m)"""


@query(
    "model_output_clean",
    f"""{O.POSTINGS}, {_MODEL_SQL} SELECT id, CASE WHEN readable THEN array_to_string({_in_order('ctags')}, ',') END AS skills,
  CASE WHEN readable THEN (['remote','hybrid','unknown','unknown'])[k % 4 + 1] END AS remote_policy,
  CASE WHEN readable THEN coalesce(salary_min, CASE WHEN k % 2 = 0 THEN 1000 END) END AS salary_min,
  CASE WHEN readable THEN coalesce(salary_max, CASE WHEN k % 2 = 0 THEN 2000 END) END AS salary_max,
  CASE WHEN readable THEN coalesce(salary_currency, CASE WHEN k % 2 = 0 THEN 'CHF' END) END AS salary_currency FROM mc""",
)
def model_output_clean(spark, sf_dir):
    pay_columns = [F.col(c) for c in ("salary_min", "salary_max", "salary_currency")]
    rows = _replies(spark, sf_dir).select("id", E.clean_reply(F.col("reply"), *pay_columns).alias("f"))
    return rows.select(
        "id", joined(F.col("f.skills"), "skills"), "f.remote_policy", "f.salary_min", "f.salary_max", "f.salary_currency"
    )


@query(
    "extract_fallback",
    f"""{O.INGEST}, facts AS ({facts_sql('feed')}), {_MODEL_SQL.replace('FROM postings', 'FROM feed')}
SELECT id, CASE WHEN readable THEN array_to_string({_in_order('ctags')}, ',') ELSE array_to_string(f_skills, ',') END AS skills,
  CASE WHEN readable THEN (['remote','hybrid','unknown','unknown'])[k % 4 + 1] ELSE f_remote END AS remote_policy
FROM mc JOIN facts USING (id)""",
)
def extract_fallback(spark, sf_dir):
    from jobstrata.operators.rebuild import with_fallback

    valid = X.crawls(spark, sf_dir).filter("ok").select("company_id")
    feed = X.feed(spark, sf_dir).join(valid, "company_id", "left_semi")
    feed = feed.withColumn("id", F.concat_ws(":", "company_id", "ats_job_id"))
    none = F.lit(None)
    replies = _replies(spark, sf_dir).select("id", E.clean_reply(F.col("reply"), none, none, none).alias("model"))
    both = E.with_heuristic_facts(feed).join(replies, "id").select(
        "id", with_fallback(F.col("model"), F.col("facts")).alias("f")
    )
    return both.select("id", joined(F.col("f.skills"), "skills"), "f.remote_policy")


@query(
    "role_family_clamp",
    """SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN 'other' WHEN c_custkey % 5 = 1 THEN 'data'
  WHEN c_custkey % 5 = 2 THEN 'engineering' WHEN c_custkey % 5 = 3 THEN 'other' ELSE 'sales' END AS role_family FROM customer""",
)
def role_family_clamp(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    label = (
        F.when(kind == 0, F.col("c_mktsegment")).when(kind == 1, " DATA ").when(kind == 2, "Engineering\n").when(kind == 4, "sales")
    )
    return X.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), E.clamp_role_family(label).alias("role_family")
    )


@query(
    "token_cost",
    f"""{O.POSTINGS} SELECT id, round(CASE WHEN k % 17 = 0 THEN 0 ELSE (500 + k % 900) / 1000000.0::DOUBLE * 2.0::DOUBLE
  + (20 + k % 60) / 1000000.0::DOUBLE * 8.0::DOUBLE END, 8) AS cost FROM postings""",
)
def token_cost(spark, sf_dir):
    cost = scoring.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return X.outcomes(spark, sf_dir).select(F.col("job_id").alias("id"), F.round(cost, 8).alias("cost"))


_SCOPE, _REGIONS = scope_sql()


@query(
    "posting_summary",
    f"""{O.POSTINGS}, s AS (SELECT *, {_SCOPE} AS scope, {_REGIONS} AS regions FROM postings)
SELECT id, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN '薪资未公开' ELSE coalesce(salary_currency, '') || ' '
    || coalesce(CAST(salary_min AS VARCHAR), 'None') || '–' || coalesce(CAST(salary_max AS VARCHAR), 'None') END AS salary,
  CASE WHEN scope IS NULL THEN '' WHEN len(regions) = 0 THEN scope ELSE scope || ' [' || array_to_string(regions, ', ') || ']' END AS scope FROM s""",
)
def posting_summary(spark, sf_dir):
    scope = remote_scope(F.col("remote_policy"), F.col("location"))
    return X.postings(spark, sf_dir).select(
        "id",
        summary.salary_text(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")).alias("salary"),
        summary.scope_text(scope["scope"], scope["regions"]).alias("scope"),
    )
