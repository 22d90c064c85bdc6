import random

from pyspark.sql import functions as F

from jobstrata.operators import ingest, maintenance
from jobstrata.operators.plugins import extract_with
from tests.helpers import NOW, by_id, companies, crawls, days_ago, explain, feed, jobs


def after(spark, state, rows, ok=None, **kwargs):
    ok = ok or {"acme": True}
    result = ingest.ingest(state, companies(spark, "acme", "beta"), feed(spark, *rows), crawls(spark, **ok), NOW, **kwargs)
    return by_id(result.jobs), by_id(result.companies)


def test_new_posting(spark):
    rows, done = after(spark, jobs(spark), [{"ats_job_id": "1", "title": "Rust dev", "description_raw": "fully remote. $100k - $150k", "posted_at": days_ago(90)}])
    job = rows["acme:1"]
    assert (job.skills, job.remote_policy, job.salary_min, job.salary_max, job.salary_currency) == (["rust"], "remote", 100000, 150000, "USD")
    assert job.first_seen_at == job.verified_at == NOW.replace(tzinfo=None) and job.delisted_at is None
    assert (job.relist_count, job.source, job.salary_inferred, job.extraction_source) == (0, "ats_public_api", False, "heuristic")
    assert abs(job.ghost_score - 0.25) < 1e-9
    assert done["acme"].last_crawled_at == NOW.replace(tzinfo=None) and done["beta"].last_crawled_at is None


def test_unchanged_only_refreshes(spark):
    state = jobs(spark, {"id": "acme:1", "skills": ["kept"], "location": "Old", "relist_count": 2})
    job = after(spark, state, [{"ats_job_id": "1", "title": " ENGINEER ", "location": "New", "apply_channel": ""}])[0]["acme:1"]
    assert (job.title, job.skills, job.location) == ("Engineer", ["kept"], "Old")
    assert job.verified_at == NOW.replace(tzinfo=None) and job.apply_channel == "https://jobs.lever.co/acme/1"
    assert job.first_seen_at == days_ago(10).replace(tzinfo=None) and abs(job.ghost_score - 0.3) < 1e-9


def test_changed_content_is_read_again(spark):
    state = jobs(spark, {"id": "acme:1", "skills": ["old"], "extraction_source": "model", "posted_at": days_ago(5)})
    job = after(spark, state, [{"ats_job_id": "1", "description_raw": "python", "location": "Remote", "salary_min": 7, "salary_currency": "EUR"}])[0]["acme:1"]
    assert (job.skills, job.location, job.remote_policy) == (["python"], "Remote", "remote")
    assert (job.salary_min, job.salary_max, job.salary_currency) == (7, None, "EUR")
    assert job.extraction_source == "model" and job.posted_at == days_ago(5).replace(tzinfo=None)


def test_vanished_postings_are_delisted_once(spark):
    state = jobs(spark, {"id": "acme:1"}, {"id": "acme:2", "delisted_at": days_ago(3)}, {"id": "beta:1", "company_id": "beta"})
    rows, _ = after(spark, state, [])
    assert rows["acme:1"].delisted_at == NOW.replace(tzinfo=None)
    assert rows["acme:2"].delisted_at == days_ago(3).replace(tzinfo=None)
    assert rows["beta:1"].delisted_at is None and rows["beta:1"].verified_at == days_ago(1).replace(tzinfo=None)


def test_failed_crawl_touches_nothing(spark):
    state = jobs(spark, {"id": "acme:1", "ghost_score": 0.9})
    rows, done = after(spark, state, [{"ats_job_id": "9"}], ok={"acme": False})
    assert set(rows) == {"acme:1"} and rows["acme:1"].delisted_at is None and rows["acme:1"].ghost_score == 0.9
    assert done["acme"].last_crawled_at is None


def test_relist_inherits_and_counts(spark):
    state = jobs(
        spark,
        {"id": "acme:1", "title": "Sr. Engineer", "delisted_at": days_ago(9), "relist_count": 4, "first_seen_at": days_ago(70)},
        {"id": "acme:2", "title": "Sr Engineer", "delisted_at": days_ago(2), "relist_count": 1, "first_seen_at": days_ago(50)},
        {"id": "beta:1", "company_id": "beta", "title": "Sr Engineer", "delisted_at": days_ago(1)},
    )
    rows, _ = after(spark, state, [{"ats_job_id": "7", "title": "SR, engineer"}, {"ats_job_id": "8", "title": "Sr Engineer"}])
    for job in (rows["acme:7"], rows["acme:8"]):  # one sibling serves both
        assert (job.relist_count, job.first_seen_at) == (2, days_ago(50).replace(tzinfo=None))


def test_vanishing_in_the_same_crawl_is_no_relist(spark):
    rows, _ = after(spark, jobs(spark, {"id": "acme:1"}), [{"ats_job_id": "2"}])
    assert rows["acme:1"].delisted_at is not None and rows["acme:2"].relist_count == 0


def test_revival_order_matters(spark):
    state = jobs(spark, {"id": "acme:1", "delisted_at": days_ago(2), "relist_count": 3})
    before, _ = after(spark, state, [{"ats_job_id": "1"}, {"ats_job_id": "2"}])
    assert before["acme:1"].delisted_at is None and before["acme:1"].relist_count == 3
    assert before["acme:2"].relist_count == 0  # the sibling was live again already
    later, _ = after(spark, state, [{"ats_job_id": "2"}, {"ats_job_id": "1"}])
    assert later["acme:2"].relist_count == 4


def test_copies_of_one_id(spark):
    state = jobs(spark, {"id": "acme:9", "title": "First", "delisted_at": days_ago(2), "relist_count": 1}, {"id": "acme:5"})
    copies = [
        {"ats_job_id": "1", "title": "First", "posted_at": days_ago(4)},
        {"ats_job_id": "1", "title": "Second"},
        {"ats_job_id": "1", "title": "second "},
        {"ats_job_id": "5"},
        {"ats_job_id": "5", "title": "Changed"},
        {"ats_job_id": "5"},
    ]
    rows, _ = after(spark, state, copies)
    assert (rows["acme:1"].relist_count, rows["acme:1"].title) == (2, "second ")
    assert rows["acme:1"].posted_at == days_ago(4).replace(tzinfo=None)
    stats = ingest.ingest_stats(state, feed(spark, *copies), crawls(spark, acme=True, beta=False)).first()
    assert (stats.jobs_new, stats.jobs_updated, stats.jobs_unchanged, stats.jobs_relisted) == (1, 3, 2, 1)
    assert (stats.companies_crawled, stats.companies_failed, stats.jobs_seen, stats.extractions) == (1, 1, 6, 4)


def test_relist_matches_a_row_by_row_replay(spark):
    """Random crawls of one company with few titles, against the order-dependent rules."""
    rng = random.Random(5)
    titles = ["a", "b", "c"]
    state_rows = [
        {"id": f"acme:{i}", "title": rng.choice(titles), "relist_count": i % 5, "first_seen_at": days_ago(100 + i),
         "delisted_at": days_ago(rng.randint(1, 6)) if rng.random() < 0.8 else None}
        for i in range(120)
    ]
    ids = rng.sample(range(220), 160)
    feed_rows = [
        {"ats_job_id": str(i), "title": state_rows[i]["title"] if i < 120 else rng.choice(titles), "feed_pos": pos * 700}
        for pos, i in enumerate(ids)
    ]
    gone = {r["id"]: dict(r) for r in state_rows if r["delisted_at"]}
    expected = {}
    for row in feed_rows:
        key = f"acme:{row['ats_job_id']}"
        if int(row["ats_job_id"]) < 120:
            gone.pop(key, None)
            continue
        fits = [g for g in gone.values() if g["title"] == row["title"]]
        if fits:
            best = min(fits, key=lambda g: (-g["delisted_at"].timestamp(), g["id"]))
            expected[key] = (best["id"], best["relist_count"] + 1)
    state = jobs(spark, *state_rows)
    accepted = ingest.accepted_feed(feed(spark, *feed_rows), crawls(spark, acme=True))
    got = {r.id: (r.sibling_id, r.relist_count) for r in ingest.relist_lookup(state, accepted).collect()}
    assert got == expected and expected


def test_plugin_replaces_the_heuristic_and_falls_back(spark):
    def make():
        def read(posting):
            if posting["title"] == "Odd":
                raise ValueError("no")
            return {"skills": ["plugin"], "remote_policy": "hybrid", "salary_min": posting["salary_min"]}
        return read

    rows, _ = after(
        spark, jobs(spark, {"id": "acme:3", "skills": ["kept"]}),
        [{"ats_job_id": "1", "salary_min": 5}, {"ats_job_id": "2", "title": "Odd", "description_raw": "rust"}, {"ats_job_id": "3"}],
        extractor=lambda fresh: extract_with(fresh, make),
    )
    assert (rows["acme:1"].skills, rows["acme:1"].salary_min) == (["plugin"], 5)
    assert rows["acme:2"].skills == ["rust"] and rows["acme:3"].skills == ["kept"]


def test_due_companies(spark):
    state = jobs(spark, {"id": "acme:1", "first_seen_at": days_ago(2)}, {"id": "beta:1", "company_id": "beta", "first_seen_at": days_ago(30)})
    base = companies(spark, "acme", "beta", "newco")
    crawled = base.withColumn("last_crawled_at", F.when(F.col("id") != "newco", F.lit(days_ago(0.5))))
    due = {r.id for r in ingest.due_companies(crawled, state, NOW).collect()}
    assert due == {"acme", "newco"}  # hot after 6 h, cold only after 24 h


def test_backfill(spark):
    state = jobs(spark, {"id": "acme:1", "updated_at": days_ago(1)}, {"id": "acme:2"}, {"id": "acme:3", "delisted_at": days_ago(1), "ghost_score": 0.7})
    fresh = feed(spark, {"ats_job_id": "1", "posted_at": days_ago(135)}, {"ats_job_id": "2"})
    ok = crawls(spark, acme=True, beta=False)
    rows = by_id(maintenance.backfill_dates(state, fresh, ok, NOW))
    assert rows["acme:1"].updated_at is None and abs(rows["acme:1"].ghost_score - 0.5) < 1e-9
    assert rows["acme:3"].ghost_score == 0.7
    stats = maintenance.backfill_stats(state, fresh, ok).first()
    assert (stats.jobs_dated, stats.jobs_no_ats_date, stats.jobs_unmatched, stats.ghost_recomputed) == (1, 1, 1, 2)
    assert (stats.companies_fetched, stats.companies_failed) == (1, 1)


def test_wide_rows_are_shuffled_once(spark, tmp_path):
    """With no side small enough to broadcast, state and feed still only move to meet on the id."""
    jobs(spark, {"id": "acme:1"}).write.parquet(str(tmp_path / "jobs"))
    feed(spark, {"ats_job_id": "1"}).write.parquet(str(tmp_path / "feed"))
    stored = spark.read.parquet(str(tmp_path / "jobs")), spark.read.parquet(str(tmp_path / "feed"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explain(ingest.ingest(stored[0], companies(spark, "acme"), stored[1], crawls(spark, acme=True), NOW).jobs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tree = plan.split("\n\n")[0].splitlines()
    top = next(i for i, line in enumerate(tree) if "FullOuter" in line)
    assert not any("Exchange" in line for line in tree[:top])
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def stored(spark, folder, state, rows):
    """State and feed as tables on disk, so that a plan tells what is read of them."""
    state.write.parquet(f"{folder}/jobs")
    feed(spark, *rows).write.parquet(f"{folder}/feed")
    return spark.read.parquet(f"{folder}/jobs"), spark.read.parquet(f"{folder}/feed")


def test_fresh_postings_need_no_text_of_the_state(spark, tmp_path):
    state = jobs(
        spark, {"id": "acme:1"}, {"id": "acme:2", "description_raw": "old", "role_family": "ops", "relist_count": 3}, {"id": "acme:3", "delisted_at": days_ago(3)},
        {"id": "acme:4", "title": "Back", "delisted_at": days_ago(2)}, {"id": "beta:1", "company_id": "beta"},
    )
    rows = [{"ats_job_id": "1"}, {"ats_job_id": "2", "description_raw": "rust"}, {"ats_job_id": "7", "title": "back"}, {"ats_job_id": "7", "title": "Back", "posted_at": days_ago(4)}]
    state, given = stored(spark, tmp_path, state, rows)
    result = ingest.ingest(state, companies(spark, "acme", "beta"), given, crawls(spark, acme=True), NOW)
    fresh = result.fresh()
    assert sorted(map(repr, fresh.collect())) == sorted(map(repr, result.changed.filter("change IN ('new', 'updated')").collect()))
    assert fresh.count() == 2
    scans = [scan for scan in explain(fresh).split("\n\n") if "Scan parquet" in scan.split("\n")[0] and "/jobs]" in scan]
    assert scans and not any("description_raw" in scan for scan in scans)


def test_counters_hash_every_feed_copy_once(spark, tmp_path):
    copies = [{"ats_job_id": "1"}, {"ats_job_id": "1", "title": "x"}]
    state, given = stored(spark, tmp_path, jobs(spark, {"id": "acme:1"}), copies)
    found = ingest.ingest_stats(state, given, crawls(spark, acme=True))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert (found.first().jobs_updated, found.first().jobs_unchanged) == (1, 1)


def test_copies_in_several_blocks(spark):
    """Counters against a replay copy by copy, with the copies of an id spread over small blocks."""
    rng = random.Random(11)
    rows = [(f"acme:{rng.randint(0, 5)}", "acme", pos - 40, rng.choice("ab")) for pos in range(120)]
    hashed = spark.createDataFrame(rows, "id string, company_id string, feed_pos long, _hash string")
    for block in (4, 4096):
        for row in ingest.copy_runs(hashed, block).collect():
            mine = [h for i, _, _, h in rows if i == row.id]
            assert (row._first_hash, row._last_hash, row.copies) == (mine[0], mine[-1], len(mine))
            assert row.turns == sum(a != b for a, b in zip(mine, mine[1:]))


def test_rows_of_a_class_equal_those_of_the_step(spark):
    """Repeated and nameless ids of the state, copies and ties of the feed: each class on its own gives the rows of the whole step."""
    state = jobs(
        spark, {"id": "acme:1"}, {"id": "acme:1", "description_raw": "other"}, {"id": "acme:1"}, {"id": "acme:2", "description_raw": "old", "relist_count": 3},
        {"id": "acme:3", "delisted_at": days_ago(3)}, {"id": "acme:4", "title": "Back", "delisted_at": days_ago(2)}, {"id": "acme:5"}, {"id": "acme:5"}, {"id": None},
        {"id": "acme:6", "content_hash": "by an earlier rule"}, {"id": "acme:8"}, {"id": "beta:1", "company_id": "beta"},
    )
    rows = [
        {"ats_job_id": "1"}, {"ats_job_id": "2", "description_raw": "rust"}, {"ats_job_id": "7", "title": "back"}, {"ats_job_id": "7", "title": "Back", "posted_at": days_ago(4)},
        {"ats_job_id": "6"}, {"ats_job_id": "8", "feed_pos": 50}, {"ats_job_id": "8", "feed_pos": 50, "description_raw": "tie"}, {"ats_job_id": None}, {"ats_job_id": "3"},
    ]
    result = ingest.ingest(state, companies(spark, "acme", "beta"), feed(spark, *rows), crawls(spark, acme=True), NOW)
    step = result.changed.collect()
    assert {r.change for r in step} == {"new", "updated", "unchanged", "delisted", "untouched"}
    for kinds in (["new"], ["updated"], ["unchanged"], ["delisted"], ["untouched"], ["new", "updated", "unchanged", "delisted", "untouched"]):
        assert sorted(map(repr, result.only(*kinds).collect())) == sorted(repr(r) for r in step if r.change in kinds)


def test_rows_of_a_class_move_no_other_text(spark, tmp_path):
    """Shuffled rows bear no text when the sources join what is decided before they read it."""
    state, given = stored(spark, tmp_path, jobs(spark, {"id": "acme:1"}, {"id": "acme:2"}), [{"ats_job_id": "1"}, {"ats_job_id": "3"}])
    texts = [df.select(F.col("id" if "id" in df.columns else "ats_job_id").alias("_key"), "description_raw") for df in (state, given)]
    met = [
        lambda rows: state.drop("description_raw").join(rows, "id").withColumn("_key", F.col("id")).join(F.broadcast(texts[0]), "_key"),
        lambda rows: given.drop("description_raw").withColumn("id", F.concat_ws(":", "company_id", "ats_job_id")).join(rows, "id").join(F.broadcast(texts[1]), F.col("ats_job_id") == F.col("_key")),
    ]
    result = ingest.ingest(state, companies(spark, "acme"), given, crawls(spark, acme=True), NOW, meet_jobs=met[0], meet_feed=met[1])
    kinds = ["new", "updated", "unchanged", "delisted", "untouched"]
    assert {(r.id, r.change) for r in result.only(*kinds).collect()} == {("acme:1", "unchanged"), ("acme:2", "delisted"), ("acme:3", "new")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explain(result.only(*kinds))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [node for node in plan.split("\n\n") if "Exchange" in node.split("\n")[0] and "BroadcastExchange" not in node.split("\n")[0]]
    assert len(exchanges) > 5 and not any("description_raw" in node and "hashpartitioning(id#" in node for node in exchanges)
