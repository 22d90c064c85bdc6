import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobstrata import schemas
from jobstrata.operators import authorize, dominance, guards, watches
from jobstrata.operators.watches import advance_cursor, check_caller, check_watches, match_counts, match_rows, top_matches
from jobstrata.sources.state import StateStore
from jobstrata.streaming.watch_totals import count_changes, register_kept, totals
from tests.helpers import NOW, days_ago, explain, jobs, table

TAGS = ["python", "rust", "go", "sql", "aws"]


def watch(name, since=None, active=True, **filters):
    full = {f: filters.get(f) for f in schemas.FILTERS.fieldNames()}
    return {
        "watch_id": name, "fingerprint": "#f", "filters": tuple(full.values()), "created_at": NOW, "last_notified_at": since, "active": active,
    }


def random_input(spark, seed=3):
    rng = random.Random(seed)
    rows = [
        {
            "id": f"acme:{i:03}", "skills": rng.sample(TAGS, rng.randint(0, 3)), "remote_policy": rng.choice(["remote", "hybrid", None]),
            "role_family": rng.choice(["Data", "sales", None]), "salary_min": rng.choice([None, 10, 20, 30]),
            "salary_max": rng.choice([None, 25, 35]), "first_seen_at": days_ago(rng.randint(0, 9)),
            "verified_at": days_ago(rng.randint(0, 40)), "delisted_at": days_ago(1) if rng.random() < 0.2 else None,
        }
        for i in range(150)
    ]
    asked = [
        watch(
            f"w{i:02}", since=rng.choice([None, days_ago(3), days_ago(6)]), active=rng.random() < 0.9,
            skills=rng.choice([None, [], *[rng.sample([t.upper() for t in TAGS], rng.randint(1, 3)) for _ in range(3)]]),
            required_skills=rng.choice([None, [], rng.sample(TAGS, 1), rng.sample(TAGS, 2)]),
            remote=rng.choice([None, True, False]), role_family=rng.choice([None, None, "data"]),
            min_salary=rng.choice([None, 15, 28]),
        )
        for i in range(60)
    ]
    return rows, asked


def brute_force(rows, asked):
    """Every watch against every posting, row by row."""
    found = {}
    for w in asked:
        if not w["active"]:
            continue
        skills, required, remote, family, floor = w["filters"]
        want, need = {s.lower() for s in skills or []}, set(required or [])
        for job in rows:
            have = set(job["skills"])
            low, high = job["salary_min"], job["salary_max"]
            if (
                job["delisted_at"]
                or (remote is True and job["remote_policy"] != "remote")
                or (floor is not None and not ((high or 0) >= floor or (low or 0) >= floor or (low is None and high is None)))
                or (w["last_notified_at"] and not job["first_seen_at"] > w["last_notified_at"])
                or (want and not want & have)
                or not need <= have
                or (family and (job["role_family"] or "").lower() != family)
            ):
                continue
            match = len(want & have) / len(want) if want else 1.0
            age = (NOW - job["verified_at"]).total_seconds() / 86400
            found[w["watch_id"], job["id"]] = 0.7 * match + 0.3 * max(0.0, min(1.0, 1 - age / 30))
    return found


@pytest.mark.parametrize("part, slice_", [(20_000, 200_000), (5, 4)])
def test_matching_equals_brute_force(spark, monkeypatch, part, slice_):
    monkeypatch.setattr(dominance, "PART", part)  # with small ones profiles and filters are dealt out
    monkeypatch.setattr(dominance, "SLICE", slice_)
    rows, asked = random_input(spark)
    expected = brute_force(rows, asked)
    w, j = table(spark, schemas.WATCHES, asked), jobs(spark, *rows)
    got = {(r.watch_id, r.id): r.score for r in match_rows(w, j, NOW).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    counts = {r.watch_id: r.matches for r in match_counts(w, j, NOW).collect()}
    assert counts == {x["watch_id"]: sum(k[0] == x["watch_id"] for k in expected) for x in asked if x["active"]}
    best = {}
    for r in top_matches(w, j, NOW, 5).orderBy("watch_id", "rank").collect():
        best.setdefault(r.watch_id, []).append(r.id)
    for name in counts:
        order = sorted((k[1] for k in expected if k[0] == name), key=lambda i: (-round(expected[name, i], 9), i))
        assert best.get(name, []) == order[:5]


def test_changes_bring_counts_up_to_date(spark, tmp_path):
    """An inverted table kept over registrations, and counts kept over changes: new, reworded, gone and back postings."""
    rows, asked = random_input(spark)
    earlier = [{**r, "skills": [], "salary_min": None, "salary_max": None} if i % 4 == 0 else r for i, r in enumerate(rows)]
    store = StateStore(spark, str(tmp_path))

    def change(kind, before, after):
        old, new = (None if r is None else jobs(spark, r).first() for r in (before, after))
        return ((after or before)["id"], "acme", kind, NOW, old and tuple(old), new and tuple(new))

    def changes(*made):
        return spark.createDataFrame(list(made), schemas.CHANGES)

    def expected(now_there, watches_there):
        found = brute_force(now_there, watches_there)
        return {w["watch_id"]: sum(k[0] == w["watch_id"] for k in found) for w in watches_there if w["active"]}

    def counted():
        return {r.watch_id: r.matches for r in totals(store).collect()}

    first, second = asked[:30], asked[30:]
    register_kept(store, table(spark, schemas.WATCHES, first), jobs(spark).limit(0))
    everything = spark.createDataFrame([(r.id, "acme", "new", NOW, None, tuple(r)) for r in jobs(spark, *earlier).collect()], schemas.CHANGES)
    count_changes(store, everything, "c-0")
    count_changes(store, everything, "c-0")  # a replay
    assert counted() == expected(earlier, first)
    register_kept(store, table(spark, schemas.WATCHES, asked), jobs(spark, *earlier))
    assert counted() == expected(earlier, asked)
    entries = store.appended("watch_entries", schemas.WATCH_ENTRIES)
    assert entries.count() == entries.dropDuplicates(["entry", "condition_id"]).count()
    later, steps = [], []
    for i, (old, new) in enumerate(zip(earlier, rows)):
        now_there = {**new, "delisted_at": days_ago(0)} if i % 10 == 1 and not new["delisted_at"] else new
        later.append(now_there)
        if now_there != old:
            steps.append(change("delisted" if now_there["delisted_at"] else "updated", old, now_there))
    count_changes(store, changes(*steps), "c-1")
    assert counted() == expected(later, asked)
    best = {r.watch_id: r.best_match for r in totals(store).collect()}
    again = {r.watch_id: r.best_match for r in match_counts(table(spark, schemas.WATCHES, asked), jobs(spark, *later)).collect()}
    assert best == again


def test_one_callers_check(spark):
    asked = [watch("hit", skills=["rust"]), watch("none", since=NOW, skills=["rust"]), {**watch("other", skills=["rust"]), "fingerprint": "#g"}, watch("off", active=False)]
    w, j = table(spark, schemas.WATCHES, asked), jobs(spark, {"id": "acme:1", "skills": ["rust"]}, {"id": "acme:2", "skills": ["rust"], "verified_at": days_ago(9)})
    report, moved = check_caller(w, j, NOW, "#f")
    got = {r.watch_id: (r.since, r.new_matches, [(m.rank, m.id) for m in r.matches]) for r in report.collect()}
    assert got == {"hit": (None, 2, [(1, "acme:1"), (2, "acme:2")]), "none": (NOW.replace(tzinfo=None), 0, [])}
    cursors = {r.watch_id: r.last_notified_at for r in moved.collect()}
    assert cursors["hit"] == NOW.replace(tzinfo=None) and cursors["other"] is None and cursors["off"] is None


def test_a_required_skill_is_entered_under_the_rarest(spark):
    w = table(spark, schemas.WATCHES, [watch("w", required_skills=["go", "rust"]), watch("v", skills=["go", "sql"], required_skills=["rust"]), watch("u", remote=True, role_family="Data")])
    often = watches.skill_frequencies(jobs(spark, {"id": "a:1", "skills": ["go", "rust"]}, {"id": "a:2", "skills": ["rust"]}))
    entries = {(r.entry, tuple(r.skills), tuple(r.required)) for r in watches.index_watches(w, often).entries.collect()}
    assert entries == {("tag go", (), ("go", "rust")), ("tag go", ("go", "sql"), ("rust",)), ("tag sql", ("go", "sql"), ("rust",)), ("open remote =data", (), ())}


def test_no_nested_loop_over_watches_and_postings(spark):
    rows, asked = random_input(spark)
    w, j = table(spark, schemas.WATCHES, asked), jobs(spark, *rows)
    for df in (match_counts(w, j, NOW), top_matches(w, j, NOW)):
        plan = explain(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cursor(spark):
    w = table(spark, schemas.WATCHES, [watch("w1", skills=["rust"]), watch("w2", since=days_ago(5), active=False)])
    j = jobs(spark, {"id": "acme:1", "skills": ["rust"]})
    first, moved = check_watches(w, j, NOW)
    assert [r.id for r in first.collect()] == ["acme:1"]
    again, _ = check_watches(moved, j, NOW + dt.timedelta(hours=1))
    assert again.count() == 0
    newer = j.unionByName(jobs(spark, {"id": "acme:2", "skills": ["rust"], "first_seen_at": NOW + dt.timedelta(minutes=5)}))
    assert [r.id for r in check_watches(moved, newer, NOW + dt.timedelta(hours=1))[0].collect()] == ["acme:2"]
    cursors = {r.watch_id: r.last_notified_at for r in advance_cursor(w, NOW).collect()}
    assert cursors == {"w1": NOW.replace(tzinfo=None), "w2": days_ago(5).replace(tzinfo=None)}


def test_registration(spark):
    rows = [
        ("1", "#a", {"skills": "Rust, ,GO", "remote": "true", "min_salary": "60k", "role_family": "Data", "junk": "x"}),
        ("2", "#a", {"skills": "go", "email": "x"}),
        ("3", "a\nb", {}),
        ("4", "#a", {"Email": "kept out by the whitelist only"}),
    ]
    requests = spark.createDataFrame(rows, "request_id string, fingerprint string, filters map<string,string>")
    errors = {r.request_id: r.error for r in watches.judge_requests(requests).collect()}
    assert errors == {"1": None, "2": "ERR_PII_NOT_ACCEPTED", "3": "ERR_RESUME_NEVER_TRANSMITTED", "4": None}
    made = watches.register_watches(requests, NOW)
    assert made.count() == 2 and made.select("watch_id").distinct().count() == 2
    f = made.filter(F.size("filters.skills") > 0).first().filters
    assert f.asDict() == {"skills": ["rust", "go"], "required_skills": [], "remote": True, "role_family": "data", "min_salary": 60000}


def test_authorisation_order(spark):
    rows = [
        ("ok", "acme:1", "#f", True, {"note": "x"}),
        ("cv", "acme:1", "#f", True, {"CV": "x"}),
        ("long", "acme:1", "x" * 201, True, {}),
        ("job", "a\nb", "#f", True, {}),
        ("no", "acme:1", "#f", None, {}),
        ("missing", "acme:9", "#f", True, None),
        ("first", "acme:9", "#f\n", False, {"resume": "x"}),
    ]
    requests = spark.createDataFrame(rows, "request_id string, job_id string, fingerprint string, authorized boolean, extra map<string,string>")
    judged = authorize.judge(requests, jobs(spark, {"id": "acme:1"}))
    errors = {r.request_id: r.error for r in judged.collect()}
    resume = "ERR_RESUME_NEVER_TRANSMITTED"
    assert errors == {"ok": None, "cv": resume, "long": resume, "job": resume, "no": "ERR_NOT_AUTHORIZED", "missing": "ERR_JOB_NOT_FOUND", "first": resume}
    receipt = authorize.accepted(judged, NOW).first()
    assert receipt.delivered_via == "employer_site" and receipt.resume_transmitted is False and receipt.apply_channel
    assert authorize.rejected(judged).count() == 6


def test_schema_guard(spark):
    good = table(spark, schemas.WATCHES, []), table(spark, schemas.APPLICATIONS, [])
    guards.assert_anonymous_schema(*good)
    with pytest.raises(ValueError, match="email"):
        guards.assert_anonymous_schema(good[0].withColumn("email", F.lit("x")), good[1])


def test_stored_watches_are_not_broadcast(spark, tmp_path):
    """Whatever the files of a table of watches say of its size, its rows stay out of the driver."""
    store = StateStore(spark, str(tmp_path))
    store.write({"watches": table(spark, schemas.WATCHES, [watch("w1", skills=["rust"]), watch("w2", min_salary=5)])})
    kept = store.read("watches", schemas.WATCHES)
    joins = [line for line in explain(watches._asked(watches.index_watches(kept), kept)).split("\n\n")[0].splitlines() if "Join" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
