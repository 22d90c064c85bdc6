import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobstrata import schemas
from jobstrata.operators import fingerprint, maintenance, rebuild
from jobstrata.operators.lifecycle import lifecycle_spans
from jobstrata.sources import landing, receipts, repo_files, snapshot
from jobstrata.sources.bootstrap import IndexExists, bootstrap
from jobstrata.sources.state import StateStore
from jobstrata.streaming.ingest_stream import apply_pages, start_ingest
from jobstrata.streaming.lifecycle_stream import LOG, SPANS, extend_spans
from tests.helpers import NOW, by_id, companies, days_ago, jobs, table


def page(company, vendor, body, status=200, no=0, ts=NOW, error=None):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return {"company_id": company, "vendor": vendor, "tenant": company, "page_no": no, "status": status, "body": text, "crawl_ts": ts, "error": error}


def pages(spark, *rows):
    return table(spark, schemas.LANDING, rows)


def test_greenhouse(spark):
    body = {"jobs": [
        {"id": 1, "title": " Dev ", "content": "&lt;p&gt;A&amp;nbsp;&amp;eacute;&lt;/p&gt;", "location": {"name": "Remote"},
         "absolute_url": "https://boards.greenhouse.io/acme/jobs/1", "first_published": "2024-05-01T00:00:00-04:00",
         "metadata": [{"name": "Location Type", "value": "Flexible"}, {"name": "LOCATION TYPE", "value": "In-Office"}]},
        {"id": "x2", "content": None, "metadata": None, "location": None},
    ]}
    one, two = landing.feed_of(pages(spark, page("acme", "greenhouse", body))).orderBy("feed_pos").collect()
    assert (one.ats_job_id, one.title, one.description_raw, one.remote_hint) == ("1", "Dev", "A\xa0é", "onsite")
    assert one.posted_at == dt.datetime(2024, 5, 1, 4) and one.apply_channel.endswith("/jobs/1") and one.salary_min is None
    assert (two.ats_job_id, two.title, two.description_raw, two.remote_hint, two.feed_pos) == ("x2", "", "", "unknown", 1)
    assert two.apply_channel == "https://boards.greenhouse.io/embed/job_app?for=acme&token=x2"


def test_lever(spark):
    body = [
        {"id": "a", "text": "T", "descriptionPlain": " d ", "categories": {"location": "Remote US"}, "workplaceType": "unspecified",
         "salaryRange": {"min": 12.7, "max": "20", "currency": "USD"}, "createdAt": 1714557600000, "applyUrl": "", "hostedUrl": "https://jobs.lever.co/acme/a"},
        {"id": "b", "workplaceType": "Hybrid", "salaryRange": {"min": "12.7", "max": 20, "currency": "USD"}, "createdAt": 0},
        {"id": "c", "salaryRange": {"min": None, "max": 9}},
    ]
    a, b, c = landing.feed_of(pages(spark, page("acme", "lever", body))).orderBy("feed_pos").collect()
    assert (a.title, a.description_raw, a.remote_hint, a.salary_min, a.salary_max) == ("T", "d", "remote", 12, 20)
    assert a.posted_at == a.updated_at == dt.datetime(2024, 5, 1, 10) and a.apply_channel == "https://jobs.lever.co/acme/a"
    assert (b.remote_hint, b.salary_min, b.salary_max, b.salary_currency, b.posted_at) == ("hybrid", None, None, "USD", None)
    assert (c.salary_min, c.salary_max, c.salary_currency) == (None, 9, None)


def test_ashby(spark):
    tiers = [{"components": [{"compensationType": "Equity", "minValue": 1}]}, {"components": None},
             {"components": [{"compensationType": "SALARY", "minValue": 100.9, "maxValue": None, "currencyCode": "EUR"}, {"compensationType": "Salary", "minValue": 5}]}]
    body = {"jobs": [
        {"id": "a", "title": "T", "isListed": True, "descriptionPlain": "", "descriptionHtml": "<p>x</p>", "isRemote": True, "compensation": {"compensationTiers": tiers}},
        {"id": "b", "isListed": False},
        {"id": "c", "isListed": None, "workplaceType": "OnSite", "publishedAt": "2024-05-01T00:00:00.123+00:00"},
    ]}
    a, c = landing.feed_of(pages(spark, page("acme", "ashby", body))).orderBy("feed_pos").collect()
    assert (a.description_raw, a.remote_hint, a.salary_min, a.salary_max, a.salary_currency) == ("x", "remote", 100, None, "EUR")
    assert (c.ats_job_id, c.remote_hint, c.posted_at) == ("c", "onsite", dt.datetime(2024, 5, 1, 0, 0, 0, 123000))


def test_validation(spark):
    rows = pages(
        spark,
        page("ok", "lever", []), page("gone", "lever", None, status=404), page("html", "ashby", "<html>"),
        page("obj", "lever", {"jobs": []}), page("arr", "greenhouse", [1]), page("noid", "greenhouse", {"jobs": [{"title": "x"}]}),
        page("badtitle", "greenhouse", {"jobs": [{"id": 1, "title": None}]}), page("net", "lever", None, status=0, error="ReadTimeout: x"),
        page("who", "workday", []), page("two", "lever", [{"id": "1"}]), page("two", "lever", "oops", no=1),
    )
    got = {r.company_id: (r.ok, r.status, r.error) for r in landing.crawl_results(rows).collect()}
    assert got == {
        "ok": (True, 200, None), "gone": (False, 404, "non-200"), "html": (False, 200, "non-json body"), "obj": (False, 200, "no jobs array"),
        "arr": (False, 200, "no jobs array"), "noid": (False, 200, "parse error"), "badtitle": (False, 200, "parse error"),
        "net": (False, 0, "ReadTimeout: x"), "who": (False, 200, "unknown vendor"), "two": (False, 200, "non-json body"),
    }
    assert landing.rejects(rows).count() == 9


def test_state_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert store.version() == 0 and store.read("jobs", schemas.JOBS).count() == 0
    store.write({"jobs": jobs(spark, {"id": "a:1"}), "companies": companies(spark, "a")}, tag="one")
    reader = store.read("jobs", schemas.JOBS)
    store.write({"jobs": jobs(spark, {"id": "a:1"}, {"id": "a:2"})}, tag="two")
    assert reader.count() == 1 and store.read("jobs", schemas.JOBS).count() == 2
    assert store.read("jobs", schemas.JOBS, version=1).count() == 1 and store.read("companies", schemas.COMPANIES).count() == 1
    assert store.has_tag("one") and not store.has_tag("three")


def test_stream_replays_change_nothing(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    store.write({"companies": companies(spark, "acme")})
    first = pages(spark, page("acme", "lever", [{"id": "1", "text": "A"}, {"id": "2", "text": "B"}], ts=days_ago(2)))
    later = pages(spark, page("acme", "lever", [{"id": "2", "text": "B"}], ts=days_ago(1)), page("new", "lever", [{"id": "1"}], ts=days_ago(1)))
    first.write.parquet(str(tmp_path / "in" / "p1"))
    run = lambda: start_ingest(store, str(tmp_path / "in" / "*"), str(tmp_path / "check"), {"availableNow": True}).awaitTermination()
    run()
    later.write.parquet(str(tmp_path / "in" / "p2"))
    run()
    rows = by_id(store.read("jobs", schemas.JOBS))
    assert set(rows) == {"acme:1", "acme:2"} and rows["acme:1"].delisted_at == days_ago(1).replace(tzinfo=None)
    version = store.version()
    apply_pages(store, later, "ingest-1")  # the same batch again
    apply_pages(store, first, "late")  # an older crawl
    assert store.version() == version


def test_snapshots(spark, tmp_path):
    store, target = StateStore(spark, str(tmp_path / "a")), StateStore(spark, str(tmp_path / "b"))
    with pytest.raises(snapshot.SnapshotError, match="missing"):
        snapshot.publish_snapshot(store, str(tmp_path / "s0"), NOW)
    store.write({"companies": companies(spark, "acme"), "jobs": jobs(spark)})
    with pytest.raises(snapshot.SnapshotError, match="0 postings"):
        snapshot.publish_snapshot(store, str(tmp_path / "s1"), NOW)
    store.write({"jobs": jobs(spark, {"id": "acme:1"}, {"id": "acme:2", "verified_at": days_ago(0.5), "delisted_at": NOW})})
    path = str(tmp_path / "s2")
    stats = snapshot.publish_snapshot(store, path, NOW + dt.timedelta(days=2)).first()
    assert (stats.companies, stats.jobs, stats.age_days) == (1, 2, 2) and stats.bytes > 0
    assert snapshot.install_snapshot(target, path, NOW).first().jobs == 2 and target.read("jobs", schemas.JOBS).count() == 2
    row = {"receipt_id": "r", "job_id": "acme:1", "fingerprint": "#f", "authorized": True}
    table(spark, schemas.APPLICATIONS, [row]).write.parquet(f"{path}/applications")
    with pytest.raises(snapshot.SnapshotError, match="applications"):
        snapshot.install_snapshot(target, path, NOW)


def test_bootstrap(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    crawl = pages(spark, page("acme", "lever", [{"id": "1"}]), page("void", "lever", []))
    candidates = spark.createDataFrame([("Acme", "lever", "acme"), ("Void", "lever", "void")], "name string, vendor string, tenant string")
    bootstrap(store, crawl, NOW, candidates=candidates)
    assert set(by_id(store.read("jobs", schemas.JOBS))) == {"acme:1"} and set(by_id(store.read("companies", schemas.COMPANIES))) == {"acme"}
    with pytest.raises(IndexExists):
        bootstrap(store, crawl, NOW, candidates=candidates)


def test_receipts(spark, tmp_path):
    row = lambda i: table(spark, schemas.RECEIPTS, [{"receipt_id": f"r{i}", "job_id": "a:1", "company": "A", "title": "T", "created_at": NOW}])
    receipts.append_receipts(row(1), str(tmp_path / "log"))
    receipts.append_receipts(row(2), str(tmp_path / "log"))
    (tmp_path / "log" / "x.json").write_text("\n\n")
    assert {r.receipt_id for r in receipts.load_receipts(spark, str(tmp_path / "log")).collect()} == {"r1", "r2"}


def test_repository_scan(spark, tmp_path):
    root = tmp_path / "code"
    for name, body in {
        "app/main.py": "x", "app/b.py": "x", "app/lib.RS": "x", "app/node_modules/z.js": "x", "app/Cargo.toml": 'tokio = "1"',
        "web/package.json": '{"dependencies": {"react": "1"}}', "web/Dockerfile": "FROM x", "infra.tf": "x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    files = repo_files.scan_repos(spark, str(root), "#f")
    row = fingerprint.fingerprints(files).first()
    assert row.skills == ["docker", "python", "react", "rust", "terraform"]
    assert row.language_pct == {"python": 66.7, "rust": 33.3} and row.repos_scanned == 2


def test_late_columns(spark):
    old = jobs(spark, {"id": "a:1"}).drop(*schemas.LATE_JOB_COLUMNS)
    new, added = maintenance.add_missing_columns(old)
    assert sorted(added) == sorted(schemas.LATE_JOB_COLUMNS) and new.first().extraction_source == "heuristic"
    same, none = maintenance.add_missing_columns(new.withColumn("extraction_source", F.lit(None).cast("string")))
    assert none == [] and same.first().extraction_source is None


def _outcomes(spark, n):
    return table(spark, schemas.OUTCOMES, [
        {"job_id": f"a:{i:02}", "ok": i != 3, "skills": ["go"], "remote_policy": "remote", "salary_min": 1, "prompt_tokens": 1000, "completion_tokens": 50}
        for i in range(n)
    ])


def test_rebuild_ceiling_and_rollback(spark):
    state = jobs(spark, *[{"id": f"a:{i:02}", "skills": ["old"], "salary_max": 9 if i == 0 else None} for i in range(10)])
    cost = 1000 / 1e6 * 2 + 50 / 1e6 * 8
    stats = rebuild.rebuild_stats(state, _outcomes(spark, 10), batch_size=2, ceiling=cost * 3).first()
    assert (stats.total_target, stats.processed, stats.updated, stats.failed, stats.halted) == (10, 4, 3, 1, True)
    done = rebuild.rebuild_extraction(state, _outcomes(spark, 10), batch_size=2, ceiling=cost * 3)
    rows = by_id(done)
    assert [i for i, r in rows.items() if r.extraction_source == "model"] and rows["a:03"].skills == ["old"] and rows["a:04"].skills == ["old"]
    assert rows["a:00"].skills == ["go"] and rows["a:00"].salary_min is None and rows["a:01"].salary_min == 1
    assert rows["a:00"].remote_policy == "remote" and rows["a:00"].skills_fallback == ["old"]
    back = by_id(rebuild.rollback_extraction(done))
    assert back["a:01"].skills == ["old"] and back["a:01"].salary_min is None and back["a:01"].extraction_source == "heuristic"
    limited = rebuild.rebuild_stats(state, _outcomes(spark, 10), batch_size=3, limit=5).first()
    assert (limited.processed, limited.halted) == (5, False)


def test_outcomes_retry_then_record(spark):
    def make():
        calls = {}

        def model(posting):
            calls[posting["id"]] = calls.get(posting["id"], 0) + 1
            if posting["id"] == "a:2" or calls[posting["id"]] < 3:
                raise RuntimeError("busy")
            return {"skills": ["x"], "remote_policy": "remote", "prompt_tokens": 1, "completion_tokens": 2}
        return model

    rows = by_id(rebuild.collect_outcomes(jobs(spark, {"id": "a:1"}, {"id": "a:2"}), make), "job_id")
    assert rows["a:1"].ok and rows["a:1"].skills == ["x"] and rows["a:1"].error is None
    assert not rows["a:2"].ok and rows["a:2"].error == "RuntimeError: busy" and rows["a:2"].prompt_tokens == 0


def test_lifecycle_stream_equals_batch(spark):
    import random

    rng = random.Random(4)
    day = lambda n: dt.date(2024, 1, n)
    rows = [("c", f"p{rng.randint(0, 9)}", day(rng.randint(1, 28)), rng.random() < 0.5) for _ in range(150)]
    whole = spark.createDataFrame(rows, LOG)
    spans = spark.createDataFrame([], SPANS)
    for low, high in ((1, 9), (10, 10), (11, 28)):
        spans = extend_spans(spans, whole.filter(F.dayofmonth("day").between(low, high)))
    columns = SPANS.fieldNames()
    as_set = lambda df: {tuple(r) for r in df.select(columns).collect()}
    assert as_set(spans) == as_set(lifecycle_spans(whole))
