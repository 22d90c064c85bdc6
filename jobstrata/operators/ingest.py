"""One crawl applied to the index: new, changed, revived, relisted and vanished postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions import scoring
from jobstrata.functions.extraction import with_heuristic_facts
from jobstrata.functions.skills import empty_skills
from jobstrata.functions.text import content_hash, normalize_title
from jobstrata.functions.urls import job_key
from jobstrata.operators.scans import BLOCK, fold_before
from jobstrata.session import as_timestamp


@dataclass(frozen=True)
class IngestResult:
    """``changed`` are the rows of ``jobs`` that belong to crawled companies, with their ``change``, ``step`` the same with the
    posting ``before``; ``untouched`` are those of the other companies. ``only(*kinds)`` makes the rows of ``changed`` of these change
    classes from the texts that they keep: which posting is of which class follows from hashes, and no other text is moved."""

    jobs: DataFrame
    companies: DataFrame
    changed: DataFrame
    step: DataFrame
    untouched: DataFrame
    only: Callable[..., DataFrame]

    def fresh(self) -> DataFrame:
        """The new and updated rows of ``changed``; no text of the state is read."""
        return self.only("new", "updated")


# --- freshness tiers ----------------------------------------------------------


def hot_companies(jobs: DataFrame, now) -> DataFrame:
    """Ids of companies where a posting appeared or vanished within the hot window."""
    edge = as_timestamp(now) - F.make_dt_interval(days=F.lit(C.HOT_WINDOW_DAYS))
    return (
        jobs.filter((F.col("first_seen_at") >= edge) | (F.col("delisted_at") >= edge))
        .select("company_id")
        .distinct()
    )


def due_companies(companies: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """Companies never crawled, or past both the tenant floor and their tier's interval."""
    age = scoring.days_between(F.col("last_crawled_at"), as_timestamp(now))
    hot = hot_companies(jobs, now).select(F.col("company_id").alias("id"), F.lit(True).alias("_hot"))
    hours = F.when(F.col("_hot"), C.HOT_INTERVAL_HOURS).otherwise(C.COLD_INTERVAL_HOURS)
    due = F.col("last_crawled_at").isNull() | (
        (age >= C.TENANT_FLOOR_MINUTES / 1440.0) & (age >= hours / F.lit(24.0))
    )
    return companies.join(hot, "id", "left").filter(due).select(companies.columns)


def crawl_plan(
    companies: DataFrame,
    jobs: DataFrame,
    now,
    wanted: DataFrame | None = None,
    respect_interval: bool = True,
) -> DataFrame:
    """The companies to crawl: the wanted ids, else the due ones, else all."""
    if wanted is not None:
        return companies.join(wanted.select("id").distinct(), "id", "left_semi")
    return due_companies(companies, jobs, now) if respect_interval else companies


# --- change detection ---------------------------------------------------------


def accepted_feed(feed: DataFrame, crawls: DataFrame) -> DataFrame:
    """Feed rows of valid crawls, with their posting id; a failed crawl touches nothing."""
    valid = crawls.filter("ok").select("company_id").distinct()
    return feed.join(valid, "company_id", "left_semi").withColumn(
        "id", job_key(F.col("company_id"), F.col("ats_job_id"))
    )


def crawl_times(crawls: DataFrame, now=None) -> DataFrame:
    """company_id and ``_at``, the time of its valid crawl: ``now`` for all, or each one's ``crawl_ts``."""
    at = F.col("crawl_ts") if now is None else as_timestamp(now)
    return crawls.filter("ok").groupBy("company_id").agg(F.max(at).alias("_at"))


def feed_keys(feed: DataFrame) -> DataFrame:
    """One narrow row per posting id: where it first occurs, under which title, how often."""
    return feed.groupBy("id").agg(
        F.min("feed_pos").alias("first_pos"),
        F.min_by("title", "feed_pos").alias("first_title"),
        F.first("company_id").alias("company_id"),
        F.count(F.lit(1)).alias("copies"),
    )


_CONTENT = ["title", "description_raw", "location", "remote_hint", "salary_min", "salary_max", "salary_currency"]


def _last_copies(feed: DataFrame) -> DataFrame:
    """One narrow row per posting id: the place of its last copy, and of dates and links the latest that are stated."""

    def latest(name: str, stated: Column) -> Column:
        return F.max_by(name, F.when(stated, F.col("feed_pos"))).alias(name)

    return feed.groupBy("id").agg(
        F.max("feed_pos").alias("_last"),
        F.max_by("_at", "feed_pos").alias("_at"),
        _companies(),
        latest("apply_channel", F.col("apply_channel") != ""),
        latest("posted_at", F.col("posted_at").isNotNull()),
        latest("updated_at", F.col("updated_at").isNotNull()),
    )


def _companies() -> Column:
    """The crawled companies that an id belongs to, nearly always one, with the time of their crawl."""
    return F.map_from_entries(F.collect_set(F.struct("company_id", "_at"))).alias("_companies")


def _of_crawled(wide: DataFrame) -> DataFrame:
    """The rows of an id's ``_companies``, with the time ``_at`` of their crawl."""
    mine = wide.filter(F.map_contains_key("_companies", F.col("company_id")))
    return mine.withColumn("_at", F.try_element_at("_companies", F.col("company_id"))).drop("_companies")


def _hash() -> Column:
    return content_hash(F.col("title"), F.col("description_raw")).alias("content_hash")


def _settled_feed(feed: DataFrame, content: list[str | Column] = _CONTENT) -> DataFrame:
    """One row per posting id. The last copy decides the content; dates and links that the last
    copy lacks come from the latest copy that has them. Only narrow columns are aggregated; texts
    join the place of their last copy, partitioned by the id alone as the index is."""
    texts = feed.select("id", "feed_pos", "company_id", "_at", *content)
    # No earlier copy passes; an equality would make the position part of the partitioning.
    narrow = _last_copies(feed).drop("_at", "_companies")
    return texts.join(narrow, "id").filter(F.col("feed_pos") >= F.col("_last")).drop("feed_pos", "_last")


def relist_lookup(jobs: DataFrame, feed: DataFrame) -> DataFrame:
    """For each new posting id the delisted sibling it continues, if any.

    Same company, same normalised title, delisted before this crawl, and not itself back in the
    feed at an earlier position; among those the latest delisted, ties by smallest id. One sibling
    may serve many new ids. Siblings are reduced to the best one per title, or to the best one
    still to come in the feed, so no pairs of siblings and newcomers are ever built.
    """
    keys = feed_keys(feed)
    norm = normalize_title(F.col("title"))
    siblings = (
        jobs.filter(F.col("delisted_at").isNotNull())
        .withColumn("norm_title", norm)
        .filter("norm_title <> ''")
        .select(
            "id",
            "company_id",
            "norm_title",
            F.struct(
                (-F.unix_micros("delisted_at")).alias("order"),
                F.col("id").alias("sibling_id"),
                F.col("relist_count").alias("relist_count"),
                F.col("first_seen_at").alias("first_seen_at"),
            ).alias("sibling"),
        )
        .join(keys.select("id", "first_pos"), "id", "left")
    )
    newcomers = (
        keys.join(jobs.select("id"), "id", "left_anti")
        .withColumn("norm_title", normalize_title(F.col("first_title")))
        .filter("norm_title <> ''")
        .select("id", "company_id", "norm_title", "first_pos")
    )
    key = ["company_id", "norm_title"]
    gone = (
        siblings.filter("first_pos IS NULL").groupBy(*key).agg(F.min("sibling").alias("_gone"))
    )
    returning = siblings.filter("first_pos IS NOT NULL")
    # Walking the feed backwards, every newcomer sees the siblings that return after it.
    later = (
        fold_before(
            returning.unionByName(newcomers, allowMissingColumns=True),
            key,
            position=-F.col("first_pos"),
            value=F.col("sibling"),
            out="_later",
        )
        .filter("sibling IS NULL")
        .select("id", *key, "_later")
    )
    return (
        later.join(gone, key, "left")
        .withColumn("_best", F.least("_gone", "_later"))
        .filter("_best IS NOT NULL")
        .select(
            "id",
            F.col("_best.sibling_id").alias("sibling_id"),
            (F.coalesce("_best.relist_count", F.lit(0)) + 1).alias("relist_count"),
            F.col("_best.first_seen_at").alias("first_seen_at"),
        )
    )


def change_classes(jobs: DataFrame, feed: DataFrame, crawls: DataFrame) -> DataFrame:
    """One narrow row per posting: ``new``, ``updated``, ``unchanged``, ``delisted`` or ``untouched``;
    ``revived`` marks a delisted id that is back. ``updates`` and ``confirmations`` count feed copies."""
    accepted = accepted_feed(feed, crawls)
    settled = _hashed(accepted).groupBy("id").agg(
        F.first("company_id").alias("_company"),
        F.max_by("_hash", "feed_pos").alias("_last_hash"),
        F.count(F.lit(1)).alias("copies"),
    )
    return _classes(_known(jobs, crawls), settled).select("id", "company_id", "change", "revived", "copies", "old_hash")


def _hashed(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        "id", "company_id", "feed_pos", content_hash(F.col("title"), F.col("description_raw")).alias("_hash")
    )


def _known(jobs: DataFrame, crawls: DataFrame) -> DataFrame:
    crawled = crawls.filter("ok").select("company_id", F.lit(True).alias("_crawled")).distinct()
    return jobs.select("id", "company_id", "content_hash", "delisted_at").join(crawled, "company_id", "left")


def _classes(known: DataFrame, settled: DataFrame) -> DataFrame:
    """Narrow rows of the index met with one row per posting id of the feed (``_company``, ``_last_hash``, ``copies``)."""
    joined = known.join(settled, "id", "full_outer")
    is_new, seen = F.col("company_id").isNull(), F.col("_last_hash").isNotNull()
    kind = (
        F.when(is_new, "new")
        .when(seen & F.equal_null("content_hash", "_last_hash"), "unchanged")
        .when(seen, "updated")
        .when(F.col("_crawled") & F.col("delisted_at").isNull(), "delisted")
        .otherwise("untouched")
    )
    return joined.withColumns(
        {
            "change": kind,
            "revived": seen & F.col("delisted_at").isNotNull(),
            "company_id": F.coalesce("company_id", "_company"),
            "copies": F.coalesce("copies", F.lit(0)),
            "old_hash": F.col("content_hash"),
        }
    )


def vanished(jobs: DataFrame, feed: DataFrame, crawls: DataFrame) -> DataFrame:
    """Live postings of validly crawled companies that the feed no longer has."""
    valid = crawls.filter("ok").select("company_id").distinct()
    seen = accepted_feed(feed, crawls).select("id")
    live = jobs.filter(F.col("delisted_at").isNull()).join(valid, "company_id", "left_semi")
    return live.join(seen, "id", "left_anti")


def copy_runs(hashed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per posting id of a feed whose contents are hashed: ``_first_hash``, ``_last_hash``, ``copies`` and ``turns``, how
    many copies differ from the one before. Copies are compared inside blocks of positions, then block with block, so no task
    holds all copies of a hot id; contents are hashed and read once."""
    placed = hashed.withColumn("_block", F.expr(f"feed_pos div {int(block)}"))
    inside = Window.partitionBy("id", "_block").orderBy("feed_pos")
    turned = (F.col("_hash") != F.lag("_hash").over(inside)).alias("_turned")
    blocks = placed.select("*", turned).groupBy("id", "_block").agg(
        F.first("company_id").alias("_company"),
        F.min_by("_hash", "feed_pos").alias("_first"),
        F.max_by("_hash", "feed_pos").alias("_last"),
        F.count(F.lit(1)).alias("_copies"),
        F.count_if("_turned").alias("_turns"),
    )
    over = Window.partitionBy("id").orderBy("_block")
    turned = F.coalesce(F.col("_first") != F.lag("_last").over(over), F.lit(False)).cast("bigint")
    return blocks.withColumn("_turns", F.col("_turns") + turned).groupBy("id").agg(
        F.first("_company").alias("_company"),
        F.min_by("_first", "_block").alias("_first_hash"),
        F.max_by("_last", "_block").alias("_last_hash"),
        F.sum("_copies").alias("copies"),
        F.sum("_turns").alias("turns"),
    )


def ingest_stats(jobs: DataFrame, feed: DataFrame, crawls: DataFrame) -> DataFrame:
    """The counters of one crawl in one row; every feed copy of an id counts. The failed tenants, whose number grows with the
    crawl, are rows of :func:`failed_tenants` instead of a list here."""
    accepted = accepted_feed(feed, crawls)
    # Rows of the index with one id each take part in its copies.
    known = _known(jobs, crawls).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("id")))
    classes = _classes(known, copy_runs(_hashed(accepted)))
    # The first copy meets the index, each later one the copy before it. What an id without a name does in a feed is one change.
    several = (F.col("copies") > 1) & F.col("id").isNotNull()
    same = F.equal_null("old_hash", "_first_hash")
    inserted = F.col("old_hash").isNull() & (F.col("change") == "new")
    first = (~inserted & ~same).cast("bigint")
    updates = F.when(several, F.col("turns") + first).otherwise((F.col("change") == "updated").cast("bigint"))
    meetings = F.col("copies") * F.coalesce("_rows", F.lit(1))
    confirmations = F.when(several, meetings - inserted.cast("bigint") - F.col("turns") - first).otherwise(
        (F.col("change") == "unchanged").cast("bigint")
    )
    counted = classes.select("change", updates.alias("updates"), confirmations.alias("confirmations"))
    changes = counted.agg(F.struct(
        F.count_if(F.col("change") == "new").alias("jobs_new"),
        F.coalesce(F.sum("updates"), F.lit(0)).alias("jobs_updated"),
        F.coalesce(F.sum("confirmations"), F.lit(0)).alias("jobs_unchanged"),
        F.count_if(F.col("change") == "delisted").alias("jobs_delisted"),
    ).alias("all"))
    relisted = relist_lookup(jobs, accepted).agg(F.count(F.lit(1)).alias("jobs_relisted"))
    companies = crawls.agg(
        F.count_if("ok").alias("companies_crawled"), F.count_if(~F.col("ok")).alias("companies_failed")
    )
    # One row each; a counter of its own per column would work the changes out as often.
    return (
        companies.withColumn("_changes", changes.scalar())
        .select("companies_crawled", "companies_failed", "_changes.*")
        .withColumn("jobs_relisted", relisted.scalar())
        .withColumn("extractions", F.col("jobs_new") + F.col("jobs_updated"))
        .withColumn("jobs_seen", F.col("jobs_new") + F.col("jobs_updated") + F.col("jobs_unchanged"))
    )


def failed_tenants(crawls: DataFrame, companies: DataFrame) -> DataFrame:
    """The tenants of failed crawls, one row each, with the reason."""
    return crawls.filter(~F.col("ok")).join(
        companies, crawls["company_id"] == companies["id"], "left"
    ).select(
        F.concat_ws(":", "ats_vendor", "ats_tenant").alias("tenant"), "status", "error"
    )


# --- the whole step -----------------------------------------------------------


def ingest(
    jobs: DataFrame,
    companies: DataFrame,
    feed: DataFrame,
    crawls: DataFrame,
    now=None,
    extractor=None,
    vocabulary: dict[str, list[str]] | None = None,
    meet_jobs: Callable[[DataFrame], DataFrame] | None = None,
    meet_feed: Callable[[DataFrame], DataFrame] | None = None,
) -> IngestResult:
    """The complete index after one crawl of any number of companies.

    ``now`` is the time of all crawls; without it each company's own ``crawl_ts`` counts. State and
    feed meet once, on the posting id; postings of companies that were not crawled stay out of it.
    Text is only read for new and changed postings.
    ``extractor`` replaces the native heuristic: a function from those rows (feed columns plus id)
    to ``(id, facts)``; rows it leaves out fall back to the heuristic.
    ``meet_jobs`` and ``meet_feed`` join narrow rows, on ``id``, to the postings of the state and of the feed (whose ids are
    ``job_key``); a source that keeps its texts apart gives its own, which join the rows before the texts. ``only`` uses them.
    """
    meet_jobs = meet_jobs or (lambda rows: jobs.join(rows, "id"))
    meet_feed = meet_feed or (lambda rows: feed.withColumn("id", job_key(F.col("company_id"), F.col("ats_job_id"))).join(rows, "id"))
    given, times = now, crawl_times(crawls, now)
    accepted = feed.join(times, "company_id").withColumn("id", job_key(F.col("company_id"), F.col("ats_job_id")))
    crawled = jobs.join(times, "company_id")
    untouched = jobs.join(times, "company_id", "left_anti").select(
        [F.col(f.name).cast(f.dataType) for f in schemas.JOBS.fields]
    )
    relisted = relist_lookup(crawled, accepted).select(
        "id", F.col("relist_count").alias("_relists"), F.col("first_seen_at").alias("_inherited")
    )
    # Joined to the feed first: behind the outer join its partitioning by id would be lost.
    settled = _settled_feed(accepted).withColumn("content_hash", _hash()).join(relisted, "id", "left")
    old = crawled.select("id", F.struct(*jobs.columns, "_at").alias("old"))
    step = _applied(settled.join(old, "id", "full_outer"), jobs.columns, extractor, vocabulary)

    def only(*kinds: str) -> DataFrame:
        # Classes are told apart by ids and hashes; what is known of a posting then goes to its text. Contents of state and feed are
        # hashed once: both classes of known postings start from the same rows.
        keyed = feed.withColumns({"content_hash": _hash(), "id": job_key(F.col("company_id"), F.col("ats_job_id"))}).drop("description_raw")
        hashes, last = _settled_feed(keyed.join(times, "company_id"), ["content_hash"]).select("id", "content_hash"), _last_copies(accepted)
        old_hashes = jobs.select("id", "company_id", F.col("content_hash").alias("_old")).join(times, "company_id")
        met = hashes.join(old_hashes, "id").withColumn("_same", F.equal_null("_old", "content_hash"))
        one = (F.min("_old") == F.max("_old")) & (F.count("_old") == F.count(F.lit(1)))
        known = met.groupBy("id").agg(
            F.bool_or("_same").alias("_any"), F.bool_and("_same").alias("_all"), F.when(one, F.min("_old")).alias("_old_hash"), _companies()
        )

        def read(rows: DataFrame) -> DataFrame:
            mine = meet_feed(rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias("_with")))
            mine = mine.select("id", "feed_pos", "company_id", *_CONTENT, "_with.*").filter(F.col("feed_pos") >= F.col("_last"))
            return _of_crawled(mine).drop("feed_pos", "_last").withColumn("content_hash", _hash())

        def kept(rows: DataFrame, text: bool = True) -> DataFrame:
            # A hash that all rows of an id share is known already.
            own = {c: F.col(c) for c in jobs.columns} | {"content_hash": F.coalesce("_with._old_hash", "content_hash")}
            if not text:
                own["description_raw"] = F.lit(None).cast("string")
            wide = meet_jobs(rows.select("id", F.struct(*rows.columns).alias("_with")))
            wide = _of_crawled(wide.select("_with", "_with._companies", *[column.alias(c) for c, column in own.items()]))
            told = [F.col(f"_with.{c}").alias(c) for c in rows.columns if c not in ("id", "_old_hash", "_companies")]
            return wide.select("id", F.struct(*jobs.columns, "_at").alias("old"), *told)

        def new() -> DataFrame:
            mine = read(last.join(crawled.select("id"), "id", "left_anti").join(relisted, "id", "left"))
            return _applied(mine.withColumn("old", F.lit(None).cast(old.schema["old"].dataType)), jobs.columns, extractor, vocabulary)

        def updated() -> DataFrame:
            # New content replaces the old text unread, so the state brings its narrow columns only.
            mine = read(last.join(kept(known.filter(~F.col("_all")).select("id", "_old_hash", "_companies"), text=False), "id"))
            return _applied(mine.filter(~F.equal_null("old.content_hash", "content_hash")), jobs.columns, extractor, vocabulary)

        def unchanged() -> DataFrame:
            mine = hashes.join(known.filter("_any").select("id", "_old_hash", "_companies"), "id")
            mine = kept(mine.join(last.drop("_last", "_companies"), "id"))
            return _applied(mine.filter(F.equal_null("old.content_hash", "content_hash")), jobs.columns, unread=True)

        def absent() -> DataFrame:
            mine = crawled.groupBy("id").agg(_companies()).join(accepted.select("id"), "id", "left_anti")
            mine = kept(mine.withColumn("_old_hash", F.lit(None).cast("string")))
            nameless = crawled.filter("id IS NULL").select("id", F.struct(*jobs.columns, "_at").alias("old"))
            mine = mine.unionByName(nameless)
            if not {"delisted", "untouched"} <= {*kinds}:
                mine = mine.filter(F.col("old.delisted_at").isNull() == F.lit("delisted" in kinds))
            return _applied(mine, jobs.columns, unread=True)

        makers = {"new": new, "updated": updated, "unchanged": unchanged, "delisted": absent, "untouched": absent}
        parts = [make().drop("before", "at") for make in dict.fromkeys(makers[kind] for kind in kinds)]
        return reduce(DataFrame.unionByName, parts)

    changed = step.drop("before", "at")
    return IngestResult(changed.drop("change").unionByName(untouched), stamp_crawled(companies, crawls, given), changed, step, untouched, only)


_FACTS = "struct<skills: array<string>, remote_policy: string, salary_min: int, salary_max: int, salary_currency: string>"


def _applied(both: DataFrame, names: list[str], extractor=None, vocabulary: dict[str, list[str]] | None = None, unread: bool = False) -> DataFrame:
    """The rows of a step from the settled feed met with the postings ``old`` (a struct of ``names`` and ``_at``): each posting after
    the crawl with its ``change``, the posting ``before`` and the time ``at``. With ``unread`` no row is new or updated; what the feed
    says of content may be missing then."""
    lacking = {"_relists": "int", "_inherited": "timestamp"}  # only a new posting has them
    if unread:
        lacking |= {f.name: f.dataType for f in schemas.FEED.fields} | {"content_hash": "string", "_at": "timestamp"}
    both = both.withColumns({name: F.lit(None).cast(kind) for name, kind in lacking.items() if name not in both.columns})
    both = both.withColumn("_now", F.coalesce("_at", "old._at"))

    is_new = F.col("old").isNull()
    seen = F.col("content_hash").isNotNull()
    fresh = seen & (is_new | ~F.equal_null("old.content_hash", "content_hash"))
    marked = both.withColumns({"_new": is_new, "_seen": seen, "_fresh": fresh})
    read = marked.withColumn("facts", F.lit(None).cast(_FACTS)) if unread else with_heuristic_facts(marked, only=F.col("_fresh"), vocabulary=vocabulary)
    if extractor is not None:
        found = extractor(marked.filter("_fresh")).select("id", F.col("facts").alias("_found"))
        read = read.join(found, "id", "left").withColumn("facts", F.coalesce("_found", "facts"))

    is_new, seen, fresh, now = F.col("_new"), F.col("_seen"), F.col("_fresh"), F.col("_now")
    kept = {name: F.col(f"old.{name}") for name in names}

    def when_fresh(value: Column | str, name: str) -> Column:
        return F.when(fresh, F.col(value) if isinstance(value, str) else value).otherwise(kept[name])

    def when_new(value: Column, name: str) -> Column:
        return F.when(is_new, value).otherwise(kept[name])

    vanished = ~seen & kept["delisted_at"].isNull()
    link = F.when(F.col("apply_channel") != "", F.col("apply_channel"))
    columns = {
        **kept,
        "id": F.col("id"),
        "company_id": F.coalesce(kept["company_id"], F.col("company_id")),
        "title": when_fresh("title", "title"),
        "description_raw": when_fresh("description_raw", "description_raw"),
        **{
            name: when_fresh(f"facts.{name}", name)
            for name in ("skills", "remote_policy", "salary_min", "salary_max", "salary_currency")
        },
        "salary_inferred": when_new(F.lit(False), "salary_inferred"),
        "location": when_fresh("location", "location"),
        "posted_at": F.coalesce("posted_at", kept["posted_at"]),
        "updated_at": F.coalesce("updated_at", kept["updated_at"]),
        "first_seen_at": when_new(F.coalesce("_inherited", now), "first_seen_at"),
        "verified_at": F.when(seen, now).otherwise(kept["verified_at"]),
        "delisted_at": F.when(vanished, now).when(~seen, kept["delisted_at"]),
        "relist_count": when_new(F.coalesce("_relists", F.lit(0)), "relist_count"),
        "source": when_new(F.lit(C.SOURCE_ATS), "source"),
        "apply_channel": F.when(seen, F.coalesce(link, kept["apply_channel"])).otherwise(
            kept["apply_channel"]
        ),
        "content_hash": when_fresh("content_hash", "content_hash"),
        "extraction_source": when_new(F.lit(C.HEURISTIC_SOURCE), "extraction_source"),
        "skills_fallback": when_new(empty_skills(), "skills_fallback"),
    }
    change = (
        F.when(is_new, "new").when(fresh, "updated").when(seen, "unchanged").when(vanished, "delisted").otherwise("untouched")
    )
    before = F.when(~is_new, F.struct(*[kept[f.name].cast(f.dataType).alias(f.name) for f in schemas.JOBS.fields if f.name in kept]))
    state = read.select(
        *[column.alias(name) for name, column in columns.items()], "_now", change.alias("change"), before.alias("before")
    ).withColumn(
        "ghost_score",
        F.when(
            F.col("delisted_at").isNull(),
            scoring.ghost_score_at(
                F.col("relist_count"), F.col("posted_at"), F.col("first_seen_at"), F.col("_now")
            ),
        ).otherwise(F.col("ghost_score")),
    )
    return state.select(*[F.col(f.name).cast(f.dataType) for f in schemas.JOBS.fields], "change", "before", F.col("_now").alias("at"))


def change_rows(step: DataFrame) -> DataFrame:
    """The change table's rows (``schemas.CHANGES``) of one step. A delisted posting that is back is ``revived``, whether its
    content changed or not; postings merely seen again, or already delisted, leave no row."""
    back = F.col("before.delisted_at").isNotNull() & F.col("delisted_at").isNull()
    kind = F.when(back, "revived").otherwise(F.col("change"))
    after = F.struct(*[F.col(f.name) for f in schemas.JOBS.fields])
    rows = step.select("id", "company_id", kind.alias("change"), "at", "before", after.alias("after"))
    return rows.filter(F.col("change").isin("new", "updated", "revived", "delisted")).select([F.col(f.name).cast(f.dataType) for f in schemas.CHANGES.fields])


def stamp_crawled(companies: DataFrame, crawls: DataFrame, now=None) -> DataFrame:
    """Companies with the time of their last valid crawl."""
    valid = crawl_times(crawls, now).withColumnRenamed("company_id", "id")
    return (
        companies.join(valid, "id", "left")
        .withColumn("last_crawled_at", F.coalesce("_at", "last_crawled_at"))
        .select(companies.columns)
    )


def recompute_ghost(jobs: DataFrame, now) -> DataFrame:
    """Staleness of every live posting as of ``now``; delisted ones keep theirs."""
    score = scoring.ghost_score_at(
        F.col("relist_count"), F.col("posted_at"), F.col("first_seen_at"), as_timestamp(now)
    )
    return jobs.withColumn(
        "ghost_score", F.when(F.col("delisted_at").isNull(), score).otherwise(F.col("ghost_score"))
    )
