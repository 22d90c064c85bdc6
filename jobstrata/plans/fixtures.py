"""A job-posting index projected from the given tables, for the registered queries.

Every order is a posting, every supplier a company, every customer a caller with a standing query;
part names are titles and whole documents are the description text. Which postings the previous
state holds and which the crawl brings is an attribute of the posting (``in_state``, ``in_feed``);
every order is in at least one of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions import scoring
from jobstrata.functions.text import content_hash
from jobstrata.functions.urls import canonical_apply_url, careers_url, resolve_apply
from jobstrata.session import as_timestamp, ensure_utc

NOW = "2001-08-15 00:00:00"
WORDS = ["python", "rust", "go", "k8s", "sql", "aws", "llm", "rag", "cuda", "java"]
LOCATIONS = ["Remote", "Remote - EMEA", "Remote - Germany", "Berlin", "Remote, US", "Remote - Japan", None, "Anywhere"]
FAMILIES = ["engineering", "data", "sales", "ops", None]
REMOTE_PHRASES = [
    "This role is fully remote. ", "Work is hybrid. ", "Work is on-site. ", "In-office days vary. ",
    "100% remote team. ", "", "",
]
PAY_PHRASES = ["", "", "Pay $120,000 - $180,000. ", "Comp: $90k–$140k. "]
PAGE = 500
TEXT_ROWS = 20_000


def now() -> Column:
    return as_timestamp(NOW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt over all tasks by their key before the wide texts are joined to them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _text_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for postings that carry their texts: at most ``TEXT_ROWS`` postings each, however many there are. The join with the
    texts multiplies its input, so partitions sized by that (as AQE does) would hold the more text the larger the tables are."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, -(-table(spark, sf_dir, "orders").count() // TEXT_ROWS))


def _rows(spark: SparkSession, sf_dir: str, name: str) -> Column:
    """Row count of a table as a scalar subquery; parquet answers it from its footers."""
    return table(spark, sf_dir, name).agg(F.count(F.lit(1))).scalar()


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    vendor, tenant = _pick(C.VENDORS, key % 3), F.concat(F.lit("t"), key)
    crawled = now() - F.make_dt_interval(hours=(key % 40).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), key).alias("id"),
        F.col("s_name").alias("name"),
        vendor.alias("ats_vendor"),
        tenant.alias("ats_tenant"),
        careers_url(vendor, tenant).alias("careers_url"),
        F.lit(False).alias("verified"),
        F.when(key % 10 != 9, crawled).alias("last_crawled_at"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its company and title: the narrow columns that postings are projected from."""
    orders = _spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % _rows(spark, sf_dir, "supplier")).alias("company_no"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("dated"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderkey") % _rows(spark, sf_dir, "part")).alias("part_no"),
        (F.col("o_orderkey") % _rows(spark, sf_dir, "documents")).alias("doc_no"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), "p_name")
    return orders.join(parts, "part_no").withColumn("company_id", F.concat(F.lit("c"), F.col("company_no")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_no"), "text")


def _with_texts(orders: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides grow with the data, and the text is read row by row afterwards: shuffle both, into the same parts."""
    tasks = _text_tasks(spark, sf_dir)
    docs = _texts(spark, sf_dir).repartition(tasks, "doc_no")
    return orders.repartition(tasks, "doc_no").join(docs.hint("merge"), "doc_no")


def _in_feed() -> Column:
    return (F.col("k") % 7 != 0) | (F.col("k") % 9 == 8)


def postings(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Every order as a posting, with the helper columns the tables below are cut from."""
    orders = _orders(spark, sf_dir)
    return _as_postings(_with_texts(orders, spark, sf_dir) if with_text else orders)


def _as_postings(df: DataFrame) -> DataFrame:
    """Rows of :func:`_orders`, with or without texts, as postings."""
    k = F.col("k")
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    vendor = _pick(C.VENDORS, F.col("company_no") % 3)
    tenant = F.concat(F.lit("t"), F.col("company_no"))
    posting_key = k.cast("string")
    hosted = F.when(
        vendor == "greenhouse",
        F.concat(F.lit("https://job-boards.greenhouse.io/"), tenant, F.lit("/jobs/"), posting_key),
    ).otherwise(canonical_apply_url(vendor, tenant, posting_key))
    vendor_url = (
        F.when(k % 5 == 0, hosted)
        .when(k % 5 == 1, F.concat(F.lit("https://careers.example.com/job?gh_jid="), posting_key))
        .when(k % 5 == 2, careers_url(vendor, tenant))
        .when(k % 5 == 3, canonical_apply_url(vendor, tenant, posting_key))
    )
    first_seen = F.col("dated") + days(k % 10)
    # Odd seconds keep the scores away from decimal ties.
    verified = now() - days(k % 45) - F.make_dt_interval(mins=(k % 1440).cast("int"), secs=F.lit(7))
    policy = (
        F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "remote")
        .when(F.col("priority") == "3-MEDIUM", "hybrid")
        .when(F.col("priority") == "4-NOT SPECIFIED", "onsite")
        .otherwise("unknown")
    )
    title = (
        F.when(k % 3 == 0, F.col("p_name"))
        .when(k % 3 == 1, F.concat(F.upper("p_name"), F.lit(".")))
        .otherwise(F.replace("p_name", F.lit(" "), F.lit(" - ")))
    )
    tags = [_pick(WORDS, F.expr(e)) for e in ("k % 10", "(k div 10) % 10", "(k div 7) % 10")]
    df = df.withColumns(
        {
            "vendor": vendor,
            "tenant": tenant,
            "ats_job_id": posting_key,
            "title": title,
            "skills": F.array_sort(F.array_distinct(F.array(*tags))),
            "remote_policy": policy,
            "salary_min": F.when(k % 4 != 0, F.floor("price").cast("int")),
            "salary_max": F.when(k % 4 > 1, F.floor(F.col("price") * 1.25).cast("int")),
            "salary_currency": F.when(k % 4 != 0, _pick(["USD", "EUR", "GBP"], k % 3)),
            "location": _pick(LOCATIONS, k % 8),
            "role_family": _pick(FAMILIES, k % 5),
            "posted_at": F.when(k % 10 != 0, F.col("dated")),
            "first_seen_at": first_seen,
            "verified_at": F.greatest(first_seen, verified),
            "delisted_at": F.when(
                (F.col("status") == "F") | (k % 6 == 1),
                F.least(F.col("dated") + days(F.lit(60)), now() - days(F.lit(1))),
            ),
            "relist_count": (k % 4).cast("int"),
            "vendor_url": vendor_url,
            "workplace": F.when((k % 2 == 0) & (policy != "unknown"), policy),
            "in_feed": _in_feed(),
            "in_state": k % 9 != 8,
        }
    ).withColumns(
        {
            "id": F.concat_ws(":", "company_id", "ats_job_id"),
            "ghost_score": scoring.ghost_score_at(
                F.col("relist_count"), F.col("posted_at"), F.col("first_seen_at"), now()
            ),
            "updated_at": F.when(F.col("vendor") == "greenhouse", F.col("first_seen_at")).otherwise(
                F.col("posted_at")
            ),
        }
    )
    if "text" in df.columns:
        df = df.withColumn(
            "description_raw",
            F.concat(
                F.lit("We use "), F.array_join("skills", ", "), F.lit(". "),
                _pick(REMOTE_PHRASES, k % 7), _pick(PAY_PHRASES, k % 4), F.col("text"),
            ),
        )
    return df


def _as_jobs(df: DataFrame, *more: str) -> DataFrame:
    """Posting rows in the index schema; columns that were not projected are null. ``more``: further columns that stay."""
    from_model = F.col("k") % 3 == 0
    text = "description_raw" in df.columns
    df = df.withColumns(
        {
            "description_raw": F.col("description_raw") if text else F.lit(None).cast("string"),
            "content_hash": content_hash(F.col("title"), F.col("description_raw"))
            if text
            else F.lit(None).cast("string"),
            "salary_inferred": F.lit(False),
            "response_sla_days": F.lit(None),
            "source": F.lit(C.SOURCE_ATS),
            "apply_channel": F.coalesce(
                "vendor_url",
                canonical_apply_url(F.col("vendor"), F.col("tenant"), F.col("ats_job_id")),
            ),
            "extraction_source": F.when(from_model, C.TARGET_SOURCE).otherwise(C.HEURISTIC_SOURCE),
            "skills_fallback": F.when(from_model, F.reverse("skills")).otherwise(
                F.array().cast("array<string>")
            ),
            "remote_policy_fallback": F.when(from_model, F.col("remote_policy")),
            "salary_min_fallback": F.when(from_model, F.col("salary_min")),
            "salary_max_fallback": F.when(from_model, F.col("salary_max")),
            "salary_currency_fallback": F.when(from_model, F.col("salary_currency")),
        }
    )
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.JOBS.fields], *more)


def jobs(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """The whole index: every posting."""
    return _as_jobs(postings(spark, sf_dir, with_text))


def state(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """The index before the crawl."""
    return _as_jobs(postings(spark, sf_dir, with_text).filter("in_state"))


def _met(spark: SparkSession, sf_dir: str, rows: DataFrame, which: str) -> DataFrame:
    """The postings that ``which`` names, joined on their id to ``rows`` (id, ``_with``), and then to their texts."""
    orders = _orders(spark, sf_dir).withColumn("id", F.concat_ws(":", "company_id", F.col("k").cast("string")))
    return _as_postings(_with_texts(orders.join(rows, "id"), spark, sf_dir)).filter(which)


def state_meets(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """:func:`state` joined on its id to ``rows`` (id, ``_with``)."""
    return _as_jobs(_met(spark, sf_dir, rows, "in_state"), "_with")


def feed_meets(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """:func:`feed` joined on its postings' id to ``rows`` (id, ``_with``)."""
    return _as_feed(_reworded(_met(spark, sf_dir, rows, "in_feed")), "id", "_with")


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of the crawl per company; some boards were gone."""
    gone = F.col("s_suppkey") % 13 == 0
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), F.col("s_suppkey")).alias("company_id"),
        (~gone).alias("ok"),
        F.when(gone, 404).otherwise(200).alias("status"),
        F.when(gone, F.lit("non-200")).alias("error"),
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings on the boards at crawl time, some of them reworded since the last crawl."""
    return _reworded(postings(spark, sf_dir, with_text=True).filter("in_feed"))


def _reworded(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "description_raw",
        F.when(F.col("k") % 5 == 0, F.concat("description_raw", F.lit(" Updated."))).otherwise(
            F.col("description_raw")
        ),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl as the vendor-neutral feed."""
    return _as_feed(published(spark, sf_dir))


def _as_feed(rows: DataFrame, *more: str) -> DataFrame:
    structured = F.col("vendor") != "greenhouse"
    hint = F.coalesce(
        "workplace",
        F.when(F.contains(F.lower("location"), F.lit("remote")), F.lit("remote")),
        F.lit("unknown"),
    )
    apply = resolve_apply(F.col("vendor"), F.col("tenant"), F.col("ats_job_id"), F.col("vendor_url"))
    return rows.select(
        "company_id",
        F.col("k").alias("feed_pos"),
        "ats_job_id",
        "title",
        "description_raw",
        apply["url"].alias("apply_channel"),
        "location",
        hint.alias("remote_hint"),
        *[
            F.when(structured, F.col(c)).alias(c)
            for c in ("salary_min", "salary_max", "salary_currency")
        ],
        "posted_at",
        "updated_at",
        *more,
    )


# --- payloads -----------------------------------------------------------------


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _greenhouse_job() -> Column:
    label = F.when(F.col("workplace") == "onsite", F.lit("On-Site")).otherwise(F.initcap("workplace"))
    markup = F.concat(F.lit("<p>"), _escaped(F.col("description_raw")), F.lit("</p>"))
    entry = _fields(name=F.lit("Location Type"), value=label)
    other = _fields(name=F.lit("Team"), value=F.lit("Remote sensing"))
    return _fields(
        id=F.col("k"),
        title=F.concat(F.lit("  "), F.col("title")),
        content=_escaped(markup),
        absolute_url=F.col("vendor_url"),
        location=_fields(name=F.col("location")),
        first_published=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        updated_at=F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        metadata=F.when(F.col("workplace").isNull(), F.array(other)).otherwise(F.array(other, entry)),
    )


def _lever_job() -> Column:
    """Pay arrives as text here, and some of it is no number."""
    bound = lambda c: F.when(F.col("k") % 16 == 2, F.lit("n/a")).otherwise(F.col(c).cast("string"))
    first_link = F.col("k") % 2 == 0
    return _fields(
        id=F.col("ats_job_id"),
        text=F.col("title"),
        descriptionPlain=F.col("description_raw"),
        categories=_fields(location=F.col("location")),
        workplaceType=F.col("workplace"),
        salaryRange=_fields(
            min=bound("salary_min"), max=F.col("salary_max").cast("string"), currency=F.col("salary_currency")
        ),
        createdAt=F.coalesce(F.unix_millis("posted_at"), F.lit(0)),
        applyUrl=F.when(first_link, F.col("vendor_url")),
        hostedUrl=F.when(~first_link, F.col("vendor_url")),
    )


def _ashby_job() -> Column:
    """Pay arrives as fractional numbers here, behind another component; some postings are hidden."""
    plain = F.col("k") % 2 == 0
    markup = F.concat(F.lit("<p>"), _escaped(F.col("description_raw")), F.lit("</p>"))
    equity = _fields(
        compensationType=F.lit("Equity"), minValue=F.lit(None).cast("double"),
        maxValue=F.lit(None).cast("double"), currencyCode=F.lit(None).cast("string"),
    )
    salary = _fields(
        compensationType=F.lit("Salary"), minValue=F.col("salary_min") + 0.75,
        maxValue=F.col("salary_max") + 0.75, currencyCode=F.col("salary_currency"),
    )
    tiers = F.array(
        _fields(components=F.array(equity)), _fields(components=F.array(salary))
    )
    return _fields(
        id=F.col("ats_job_id"),
        title=F.col("title"),
        descriptionPlain=F.when(plain, F.col("description_raw")),
        descriptionHtml=F.when(~plain, markup),
        isListed=F.when(F.col("k") % 3 != 0, F.col("k") % 11 != 0),
        publishedAt=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"),
        location=F.col("location"),
        workplaceType=F.when(F.col("workplace") != "remote", F.initcap("workplace")),
        isRemote=F.col("workplace") == "remote",
        compensation=_fields(compensationTiers=tiers),
        jobUrl=F.col("vendor_url"),
    )


def _sized(listed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed postings that have a text, with ``page_size``, the postings of their page, and ``page_count``, the pages of their
    company. A text that occurs twice makes two postings. Only narrow rows are shuffled."""
    texts = _texts(spark, sf_dir).groupBy("doc_no").agg(F.count(F.lit(1)).alias("_texts"))
    page = Window.partitionBy("company_id", "page_no")
    sized = listed.join(texts.hint("merge"), "doc_no").withColumn("page_size", F.sum("_texts").over(page)).drop("_texts")
    counts = sized.groupBy("company_id", "page_no").agg(F.count(F.lit(1))).groupBy("company_id").agg(F.count("page_no").alias("page_count"))
    return sized.join(counts, "company_id")


def landing(spark: SparkSession, sf_dir: str, vendor: str | None = None) -> DataFrame:
    """The crawl as raw payload pages of at most ``PAGE`` postings, failed crawls included."""
    # What does not need the texts comes before them. Texts are shuffled to their pages only where a page has several postings;
    # a page of one is written where its text is.
    failed = crawls(spark, sf_dir).filter(~F.col("ok"))
    listed = _orders(spark, sf_dir).filter(_in_feed()).withColumn("page_no", F.expr(f"k div {PAGE}"))
    listed = listed.join(failed.select("company_id"), "company_id", "left_anti")
    builders = {"greenhouse": _greenhouse_job(), "lever": _lever_job(), "ashby": _ashby_job()}
    page = ["company_id", "page_no", "page_count", "vendor", "tenant"]
    pages = None
    for name, job in builders.items():
        if vendor not in (None, name):
            continue
        mine = _sized(listed.filter(F.col("company_no") % 3 == C.VENDORS.index(name)), spark, sf_dir)
        dealt = _with_texts(mine.filter("page_size > 1"), spark, sf_dir).repartition(_text_tasks(spark, sf_dir), "company_id", "page_no")
        gathered = _reworded(_as_postings(dealt)).groupBy(*page).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("k", job.alias("job")))), lambda r: r["job"]).alias("jobs")
        )
        single = _reworded(_as_postings(_with_texts(mine.filter("page_size = 1"), spark, sf_dir))).select(*page, F.array(job).alias("jobs"))
        grouped = gathered.unionByName(single)
        body = F.to_json("jobs") if name == "lever" else F.to_json(F.struct("jobs"))
        made = grouped.select(
            "company_id", F.lit(name).alias("vendor"), "tenant", "page_no", F.lit(200).alias("status"), body.alias("body"),
            F.lit(None).cast("string").alias("error"), now().alias("crawl_ts"), "page_count",
        )
        pages = made if pages is None else pages.unionByName(made)
    return pages.unionByName(_bad_pages(spark, sf_dir)) if vendor is None else pages


def _bad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed companies' crawls: each kind of failure in turn."""
    kind = (F.expr("s_suppkey div 13") % 6).cast("int")
    failures = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 13 == 0)
    vendor = F.when(kind == 4, F.lit("workday")).when(kind == 5, F.lit("greenhouse")).otherwise(
        _pick(C.VENDORS, F.col("s_suppkey") % 3)
    )
    return failures.select(
        F.concat(F.lit("c"), F.col("s_suppkey")).alias("company_id"),
        vendor.alias("vendor"),
        F.concat(F.lit("t"), F.col("s_suppkey")).alias("tenant"),
        F.lit(0).cast("bigint").alias("page_no"),
        _pick([404, 200, 200, 0, 200, 200], kind).alias("status"),
        _pick(
            [None, "<html>busy</html>", '{"jobs": 3}', None, '{"jobs": []}', '{"jobs": [{"title": "no id"}]}'],
            kind,
        ).alias("body"),
        F.when(kind == 3, F.lit("ConnectTimeout: timed out")).alias("error"),
        now().alias("crawl_ts"),
        F.lit(None).cast("bigint").alias("page_count"),
    )


# --- callers ------------------------------------------------------------------


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standing query per customer."""
    c = F.col("c_custkey")
    none = F.array().cast("array<string>")
    first, second = _pick(WORDS, c % 10), _pick(WORDS, (3 * c) % 10)
    filters = F.struct(
        F.when(c % 8 == 7, none).otherwise(F.array_distinct(F.array(first, second))).alias("skills"),
        F.when(c % 4 == 0, F.array(first)).when(c % 16 == 15, F.array(second)).otherwise(none).alias("required_skills"),
        F.when(c % 3 == 0, F.lit(True)).when(c % 3 == 1, F.lit(False)).alias("remote"),
        F.when(c % 7 == 0, F.lit("engineering")).alias("role_family"),
        F.when(c % 5 == 0, (F.abs(F.floor(F.col("c_acctbal") / 1000)) * 50_000).cast("int")).alias("min_salary"),
    )
    cursor = as_timestamp("1999-01-01 00:00:00") + F.make_dt_interval(days=((c % 30) * 20).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("w_"), c).alias("watch_id"),
        F.concat(F.lit("#f"), c % 20).alias("fingerprint"),
        filters.alias("filters"),
        as_timestamp("1998-01-01 00:00:00").alias("created_at"),
        F.when(c % 2 == 1, cursor).alias("last_notified_at"),
        (c % 11 != 0).alias("active"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an external model said about each posting of the index."""
    k = F.col("k")
    ok = k % 17 != 0
    pay = ok & (k % 2 == 0)
    return postings(spark, sf_dir).select(
        F.col("id").alias("job_id"),
        ok.alias("ok"),
        F.when(ok, F.array_distinct(F.array(_pick(WORDS, (k + 1) % 10), _pick(WORDS, (k + 3) % 10))))
        .otherwise(F.array().cast("array<string>"))
        .alias("skills"),
        F.when(ok, "hybrid").otherwise("unknown").alias("remote_policy"),
        F.when(pay, 1).alias("salary_min"),
        F.when(pay, 2).alias("salary_max"),
        F.when(pay, "EUR").alias("salary_currency"),
        F.when(ok, 500 + k % 900).otherwise(0).cast("int").alias("prompt_tokens"),
        F.when(ok, 20 + k % 60).otherwise(0).cast("int").alias("completion_tokens"),
        F.when(~ok, F.lit("TimeoutError: no reply")).alias("error"),
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawl observations: users are postings, an error means the posting was not seen."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id") % 10).alias("company_id"),
        F.col("user_id").cast("string").alias("posting_id"),
        F.to_date("ts").alias("day"),
        (F.col("event_type") != "error").alias("observed"),
    )
