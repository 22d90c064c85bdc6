"""Crawls and postings that arrive in pieces, late or broken."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions.skills import lowered_text, skills_in
from jobstrata.operators import guards, rebuild, watches
from jobstrata.session import ensure_checkpoint_dir
from jobstrata.sources import landing
from jobstrata.sources.state import StateStore
from jobstrata.streaming.ingest_stream import apply_pages, split_repeated, start_ingest
from jobstrata.streaming.watch_stream import match_batch
from tests.helpers import NOW, by_id, companies, days_ago, explain, jobs, table
from tests.test_sources import page, pages
from tests.test_watches import watch


def at(hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 6, 1, hour, minute, tzinfo=dt.timezone.utc)


def plain(moment):
    return moment.replace(tzinfo=None)


def store_with(spark, path, *ids):
    store = StateStore(spark, str(path))
    store.write({"companies": companies(spark, *ids)})
    return store


def part(company, ids, no, count, ts):
    return {**page(company, "lever", [{"id": i, "text": i} for i in ids], no=no, ts=ts), "page_count": count}


def test_a_crawl_split_over_batches_waits_and_loses_nothing(spark, tmp_path):
    store = store_with(spark, tmp_path, "a")
    apply_pages(store, pages(spark, part("a", ["1", "2"], 0, 2, at(10))), "s-0")
    assert store.read("jobs", schemas.JOBS).count() == 0 and store.read("waiting_pages", schemas.LANDING).count() == 1
    apply_pages(store, pages(spark, part("a", ["1", "2"], 0, 2, at(10)), part("a", ["3"], 1, 2, at(10))), "s-1")
    assert set(by_id(store.read("jobs", schemas.JOBS))) == {"a:1", "a:2", "a:3"} and store.read("waiting_pages", schemas.LANDING).count() == 0
    # the next crawl comes in pieces too: a:3 is still published, on its second page
    apply_pages(store, pages(spark, part("a", ["1"], 0, 2, at(12))), "s-2")
    assert by_id(store.read("jobs", schemas.JOBS))["a:3"].delisted_at is None
    apply_pages(store, pages(spark, part("a", ["3"], 1, 2, at(12))), "s-3")
    rows = by_id(store.read("jobs", schemas.JOBS))
    assert rows["a:3"].delisted_at is None and rows["a:2"].delisted_at == plain(at(12))


def test_companies_keep_their_own_crawl_time(spark, tmp_path):
    store = store_with(spark, tmp_path, "a", "b")
    apply_pages(store, pages(spark, page("a", "lever", [{"id": "1"}], ts=at(10)), page("b", "lever", [{"id": "1"}], ts=at(10, 30))), "s-0")
    known = by_id(store.read("companies", schemas.COMPANIES))
    assert known["a"].last_crawled_at == plain(at(10)) and known["b"].last_crawled_at == plain(at(10, 30))
    rows = by_id(store.read("jobs", schemas.JOBS))
    assert rows["a:1"].first_seen_at == plain(at(10)) and rows["b:1"].verified_at == plain(at(10, 30))
    apply_pages(store, pages(spark, page("a", "lever", [{"id": "2"}], ts=at(10, 20))), "s-1")
    assert by_id(store.read("jobs", schemas.JOBS))["a:1"].delisted_at == plain(at(10, 20))


def test_a_later_failed_crawl_does_not_hide_a_good_one(spark, tmp_path):
    store = store_with(spark, tmp_path, "a")
    apply_pages(store, pages(spark, page("a", "lever", [{"id": "1"}], ts=at(10)), page("a", "lever", None, status=503, ts=at(11))), "s-0")
    assert set(by_id(store.read("jobs", schemas.JOBS))) == {"a:1"}


def test_a_new_checkpoint_on_an_old_store_skips_nothing(spark, tmp_path):
    store = store_with(spark, tmp_path / "state", "a")
    for number, ids in enumerate((["1"], ["1", "2"])):
        pages(spark, page("a", "lever", [{"id": i} for i in ids], ts=at(10 + number))).write.parquet(str(tmp_path / f"in{number}" / "p"))
        start_ingest(store, str(tmp_path / f"in{number}" / "*"), str(tmp_path / f"check{number}"), {"availableNow": True}).awaitTermination()
    assert set(by_id(store.read("jobs", schemas.JOBS))) == {"a:1", "a:2"}


def test_late_postings_reach_watches_and_new_watches_see_all(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    store.write({"watches": table(spark, schemas.WATCHES, [watch("old", since=days_ago(3), skills=["rust"])])})
    out, seen = str(tmp_path / "out"), lambda: {(r.watch_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    match_batch(store, jobs(spark, {"id": "acme:1", "skills": ["rust"], "first_seen_at": at(10, 5)}), out, "w-0", at(10, 10))
    match_batch(store, jobs(spark, {"id": "acme:2", "skills": ["rust"], "first_seen_at": at(10)}), out, "w-1", at(10, 20))
    assert seen() == {("old", "acme:1"), ("old", "acme:2")}
    both = store.read("watches", schemas.WATCHES).unionByName(table(spark, schemas.WATCHES, [watch("new", skills=["rust"])]))
    store.write({"watches": both})
    match_batch(store, jobs(spark, {"id": "acme:3", "skills": ["rust"], "first_seen_at": at(9)}), out, "w-2", at(10, 30))
    assert seen() == {("old", f"acme:{k}") for k in (1, 2, 3)} | {("new", f"acme:{k}") for k in (1, 2, 3)}
    match_batch(store, jobs(spark, {"id": "acme:9", "skills": ["rust"]}), out, "w-2", at(10, 40))  # a replay
    assert len(seen()) == 6


@pytest.mark.parametrize("vendor", ["lever", "ashby"])
def test_large_pages_are_read_posting_by_posting(spark, monkeypatch, vendor):
    monkeypatch.setattr(landing, "WHOLE_BODY", 10)
    listed = [{"id": str(k), "title": "T", "text": "T"} for k in range(3)]
    body = listed if vendor == "lever" else {"next": {"x": [1]}, "jobs": listed}
    rows = pages(
        spark, page("ok", vendor, body), page("cut", vendor, '{"jobs": [{"id": "1"}, {"id"' if vendor == "ashby" else '[{"id": "1"}, {"id"'), page("odd", vendor, {"other": "thing"}),
        page("html", vendor, "<html>busy</html>"), page("none", vendor, {"jobs": [], "padding": "xxxxxx"} if vendor == "ashby" else "[         ]"),
    )
    got = {r.company_id: (r.ok, r.jobs) for r in landing.crawl_results(rows).collect()}
    assert got == {"ok": (True, 3), "cut": (False, 0), "odd": (False, 0), "html": (False, 0), "none": (True, 0)}
    assert {r.ats_job_id for r in landing.feed_of(rows).collect()} == {"0", "1", "2"}


def test_a_body_beyond_the_limit_of_one_value(spark):
    """140 MB in one page; the engine takes less than that as a single value."""
    text = F.repeat(F.lit("x"), 1 << 20)
    body = F.concat(F.lit('{"jobs":['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(140)), lambda k: F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","descriptionPlain":"'), text, F.lit('"}'))), ","), F.lit("]}"))
    one = pages(spark, page("big", "ashby", "?")).withColumn("body", body)
    assert landing.feed_of(one).select("ats_job_id", F.length("description_raw").alias("n")).filter(f"n = {1 << 20}").count() == 140


def test_unreadable_salary_floor_is_refused(spark):
    made = [("1", "#f", {"min_salary": "lots"}), ("2", "#f", {"min_salary": "120k"}), ("3", "#f", {"min_salary": ""}), ("4", "#f", {"skills": "go"})]
    requests = spark.createDataFrame(made, "request_id string, fingerprint string, filters map<string,string>")
    got = {r.request_id: r.error for r in watches.judge_requests(requests).collect()}
    assert got == {"1": C.ERR_SALARY, "2": None, "3": None, "4": None}
    assert watches.register_watches(requests, NOW).count() == 3


def test_any_pattern_of_a_callers_vocabulary(spark):
    vocabulary = {
        "js": ["node|deno"], "years": [r"\d+ years"], "sql": ["sql*"], "rust": ["Rust"], "db": ["vector (database|store)"], "go": [r"\bgo\b"], "cpp": [r"c\+\+"], "pair": ["x{2}"],
        "class": ["[abc]z"], "none": ["never"],
    }
    df = spark.createDataFrame([("we use DENO, 12 years of RUST, a Vector Store, C++ and xx with bz; ségo",), ("go sq",)], "text string")
    found = df.select(skills_in(lowered_text(F.col("text")), vocabulary, 20).alias("tags")).collect()
    assert [r.tags for r in found] == [["js", "years", "rust", "db", "cpp", "pair", "class"], ["sql", "go"]]


def test_one_callers_watches_only(spark):
    two = [watch("mine", skills=["go"]), {**watch("other", skills=["go"]), "fingerprint": "#g"}]
    found, moved = watches.check_watches(table(spark, schemas.WATCHES, two), jobs(spark, {"id": "acme:1", "skills": ["go"]}), NOW, fingerprint="#f")
    assert [r.watch_id for r in found.collect()] == ["mine"]
    assert {r.watch_id: r.last_notified_at is None for r in moved.collect()} == {"mine": False, "other": True}


def test_schema_report_names_and_counts(spark):
    good = table(spark, schemas.WATCHES, [watch("a"), watch("b")])
    assert guards.schema_report(good, schemas.WATCHES).count() == 0
    drifted = good.withColumn("email", F.when(F.col("watch_id") == "a", "x@y.z"))
    assert [tuple(r) for r in guards.schema_report(drifted, schemas.WATCHES).collect()] == [("email", 1)]


def test_family_outcomes_are_clamped(spark):
    def make():
        def model(posting):
            if posting["id"] == "acme:3":
                raise RuntimeError("busy")
            return {"role_family": {"acme:1": " Data ", "acme:2": "wizardry"}[posting["id"]], "prompt_tokens": 1, "completion_tokens": 1}
        return model

    some = jobs(spark, *[{"id": f"acme:{k}"} for k in (1, 2, 3)])
    rows = by_id(rebuild.collect_family_outcomes(some, make, attempts=2, parallel=3, pause=0.01), "job_id")
    assert (rows["acme:1"].role_family, rows["acme:2"].role_family, rows["acme:3"].role_family) == ("data", "other", None)
    assert rows["acme:3"].error == "RuntimeError: busy" and not rows["acme:3"].ok


def test_checkpoint_folder_on_a_cluster_must_be_set():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_log_days_may_come_late_and_split(spark, tmp_path):
    import random

    from jobstrata.operators.lifecycle import lifecycle_spans
    from jobstrata.streaming.lifecycle_stream import LOG, SPANS, apply_log

    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 2)}", f"p{rng.randint(0, 9)}", dt.date(2024, 1, rng.randint(1, 28)), rng.random() < 0.6) for _ in range(200)]
    whole = spark.createDataFrame(rows, LOG)
    store = StateStore(spark, str(tmp_path))
    first_half = {15: 0, 24: 2}  # the batches with one half of these days; the other half comes later
    for number, days in enumerate((range(10, 16), range(1, 10), range(15, 25), range(24, 29))):
        some = [r for k, r in enumerate(rows) if r[2].day in days and (r[2].day not in first_half or (number == first_half[r[2].day]) == (k % 2 == 0))]
        apply_log(store, spark.createDataFrame(some, LOG), f"l-{number}")
    as_set = lambda df: {tuple(r) for r in df.select(SPANS.fieldNames()).collect()}
    assert as_set(store.read("spans", SPANS)) == as_set(lifecycle_spans(whole))
    assert store.prune(keep=1) == 6 and as_set(store.read("spans", SPANS)) == as_set(lifecycle_spans(whole))


def test_only_repeated_pages_are_shuffled_with_their_bodies(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), ("b", None, "z"), ("c", None, "w"), ("a", 1, "y")]
    pages = spark.createDataFrame([(c, NOW, p, b) for c, p, b in rows], "company_id string, crawl_ts timestamp, page_no bigint, body string")
    pages.write.parquet(f"{tmp_path}/pages")
    single, repeated = split_repeated(StateStore(spark, f"{tmp_path}/state"), spark.read.parquet(f"{tmp_path}/pages"))
    found = lambda df: sorted((r["company_id"], r["page_no"] is None, r["body"]) for r in df.collect())
    assert found(single) == [("a", False, "x"), ("c", True, "w")]
    assert found(repeated) == [("a", False, "y"), ("b", True, "z")]
    assert "hashpartitioning" not in explain(single) and "SortMergeJoin" not in explain(single)
