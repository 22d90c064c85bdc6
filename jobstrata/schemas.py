"""Explicit schemas of every table; readers use them instead of inference."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SKILLS = T.ArrayType(_S)

COMPANIES = _struct(
    ("id", _S), ("name", _S), ("ats_vendor", _S), ("ats_tenant", _S), ("careers_url", _S),
    ("verified", _B), ("last_crawled_at", _TS),
)

JOBS = _struct(
    ("id", _S), ("company_id", _S), ("title", _S), ("description_raw", _S), ("skills", SKILLS),
    ("role_family", _S), ("remote_policy", _S), ("salary_min", _I), ("salary_max", _I),
    ("salary_currency", _S), ("salary_inferred", _B), ("location", _S), ("posted_at", _TS),
    ("updated_at", _TS), ("first_seen_at", _TS), ("verified_at", _TS), ("delisted_at", _TS),
    ("relist_count", _I), ("ghost_score", _D), ("response_sla_days", _I), ("source", _S),
    ("apply_channel", _S), ("content_hash", _S), ("extraction_source", _S),
    ("skills_fallback", SKILLS), ("remote_policy_fallback", _S), ("salary_min_fallback", _I),
    ("salary_max_fallback", _I), ("salary_currency_fallback", _S),
)

# Columns added to the index after its first release; see operators.maintenance.add_missing_columns.
LATE_JOB_COLUMNS = [
    "extraction_source", "skills_fallback", "remote_policy_fallback", "salary_min_fallback",
    "salary_max_fallback", "salary_currency_fallback", "posted_at", "updated_at", "role_family",
]

FEED = _struct(
    ("company_id", _S), ("feed_pos", _L), ("ats_job_id", _S), ("title", _S), ("description_raw", _S),
    ("apply_channel", _S), ("location", _S), ("remote_hint", _S), ("salary_min", _I),
    ("salary_max", _I), ("salary_currency", _S), ("posted_at", _TS), ("updated_at", _TS),
)

# What a crawl did to one posting: new, updated, revived or delisted, and the posting before and after.
CHANGES = _struct(
    ("id", _S), ("company_id", _S), ("change", _S), ("at", _TS), ("before", JOBS), ("after", JOBS),
)

CRAWLS = _struct(("company_id", _S), ("ok", _B), ("status", _I), ("error", _S))

# A crawl of one tenant may land as several bounded pages; page_no keeps their order. page_count says
# how many different pages the crawl has; null means that nothing more is to come.
LANDING = _struct(
    ("company_id", _S), ("vendor", _S), ("tenant", _S), ("page_no", _L), ("status", _I),
    ("body", _S), ("error", _S), ("crawl_ts", _TS), ("page_count", _L),
)

FILTERS = _struct(
    ("skills", SKILLS), ("required_skills", SKILLS), ("remote", _B), ("role_family", _S),
    ("min_salary", _I),
)

WATCHES = _struct(
    ("watch_id", _S), ("fingerprint", _S), ("filters", FILTERS), ("created_at", _TS),
    ("last_notified_at", _TS), ("active", _B),
)

# Standing queries by what a posting must have to meet them; see operators.watches.index_watches.
WATCH_ENTRIES = _struct(
    ("entry", _S), ("condition_id", _S), ("skills", SKILLS), ("required", SKILLS), ("remote_only", _B), ("family", _S),
)
WATCH_FILTERS = _struct(("filter_id", _S), ("condition_id", _S), ("floor", _I))
SUBSCRIPTIONS = _struct(("watch_id", _S), ("filter_id", _S))
WATCH_TOTALS = _struct(("watch_id", _S), ("level", _I), ("n", _L))

APPLICATIONS = _struct(
    ("receipt_id", _S), ("job_id", _S), ("fingerprint", _S), ("authorized", _B),
    ("delivered_via", _S), ("created_at", _TS),
)

OUTCOMES = _struct(
    ("job_id", _S), ("ok", _B), ("skills", SKILLS), ("remote_policy", _S), ("salary_min", _I),
    ("salary_max", _I), ("salary_currency", _S), ("prompt_tokens", _I), ("completion_tokens", _I),
    ("error", _S),
)

FAMILY_OUTCOMES = _struct(
    ("job_id", _S), ("ok", _B), ("role_family", _S), ("prompt_tokens", _I),
    ("completion_tokens", _I), ("error", _S),
)

RECEIPTS = _struct(
    ("receipt_id", _S), ("job_id", _S), ("company", _S), ("title", _S), ("created_at", _TS),
)

FINGERPRINTS = _struct(
    ("id", _S), ("skills", SKILLS), ("language_pct", T.MapType(_S, _D)), ("repos_scanned", _L),
    ("created_at", _TS),
)

REPO_FILES = _struct(
    ("fingerprint", _S), ("repo", _S), ("path", _S), ("name", _S), ("suffix", _S), ("text", _S),
)
