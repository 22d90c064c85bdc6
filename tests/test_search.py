from jobstrata.operators import search
from jobstrata.operators.search import SearchParams
from tests.helpers import NOW, companies, days_ago, explain, jobs


def ids(rows):
    return [r.job_id for r in rows.collect()]


def sample(spark):
    return jobs(
        spark,
        {"id": "acme:1", "skills": ["rust", "k8s"], "remote_policy": "remote", "salary_min": 150, "salary_max": 200, "salary_currency": "USD", "role_family": "Engineering"},
        {"id": "acme:2", "skills": ["Rust"], "remote_policy": "remote", "location": "Remote - EMEA"},
        {"id": "beta:1", "company_id": "beta", "skills": ["go"], "remote_policy": "onsite", "salary_max": 100, "verified_at": days_ago(40)},
        {"id": "beta:2", "company_id": "beta", "skills": ["rust"], "delisted_at": days_ago(1)},
        {"id": "gone:1", "company_id": "gone", "skills": None},
    )


def test_filters_and_order(spark):
    find = lambda **kw: ids(search.search_jobs(sample(spark), companies(spark, "acme", "beta"), SearchParams(**kw), NOW))
    assert find() == ["acme:1", "acme:2", "gone:1", "beta:1"]
    assert find(skills=["RUST", "k8s"]) == ["acme:1", "acme:2"]
    assert find(required_skills=["rust", "K8S"]) == ["acme:1"]
    assert find(remote=True) == ["acme:1", "acme:2"] and len(find(remote=False)) == 4
    assert find(min_salary=180) == ["acme:1", "acme:2", "gone:1"]
    assert find(min_salary=180, require_stated_salary=True) == ["acme:1"]
    assert find(currency="usd") == ["acme:1"]
    assert find(remote_scope="region_locked") == ["acme:2"]
    assert find(role_family="engineering") == ["acme:1"]
    assert find(since=days_ago(5)) == []


def test_limit_is_clamped(spark):
    rows = jobs(spark, *[{"id": f"acme:{i:03}"} for i in range(130)])
    size = lambda n: search.search_jobs(rows, companies(spark, "acme"), SearchParams(), NOW, n).count()
    assert (size(0), size(20), size(1000)) == (1, 20, 100)


def test_record(spark):
    row = search.search_jobs(sample(spark), companies(spark, "acme"), SearchParams(skills=["rust", "k8s"]), NOW).first()
    assert (row.company, row.company_id, row.days_open, row.match_quality, row.remote_scope) == ("Acme", "acme", 10, 1.0, "worldwide")
    unknown = [r for r in search.search_jobs(sample(spark), companies(spark, "acme"), SearchParams(), NOW).collect() if r.job_id == "gone:1"]
    assert unknown[0].company == "gone" and unknown[0].skills == []


def test_company_info_is_aggregate_only(spark):
    info = {r.company_id: r for r in search.company_info(sample(spark), companies(spark, "acme", "idle")).collect()}
    assert info["acme"].active_jobs == 2 and info["idle"].active_jobs == 0 and info["idle"].ghost_score_avg is None
    assert set(search.company_info(sample(spark), companies(spark, "acme")).columns) == {
        "company_id", "company", "ghost_score_avg", "active_jobs", "index_built_at",
    }


def test_filters_reach_the_scan(spark, tmp_path):
    sample(spark).write.parquet(str(tmp_path / "jobs"))
    stored = spark.read.parquet(str(tmp_path / "jobs"))
    physical = explain(search.search_jobs(stored, companies(spark, "acme"), SearchParams(remote=True, currency="usd"), NOW))
    assert "EqualTo(remote_policy,remote)" in physical and "IsNull(delisted_at)" in physical
    assert "description_raw" not in physical and "TakeOrderedAndProject" in physical
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
