import random

import pytest

from pyspark.sql import functions as F

from jobstrata.operators import rebuild
from jobstrata.operators.scans import fold_before, global_order, running_totals


def test_fold_before_equals_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.choice([None, rng.randint(0, 99)])) for k in ("hot", "cold") for p in rng.sample(range(3000), 900 if k == "hot" else 5)]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    for how in ("min", "last"):
        got = {(r.k, r.p): r.o for r in fold_before(df, ["k"], F.col("p"), F.col("v"), "o", how, block=64).collect()}
        for k in ("hot", "cold"):
            carried = None
            for _, p, v in sorted(r for r in rows if r[0] == k and True):
                assert got[k, p] == carried
                if v is not None:
                    carried = v if how == "last" or carried is None else min(carried, v)


def test_global_order_equals_a_sort(spark):
    rng = random.Random(2)
    rows = [(f"c{i}:{rng.randint(0, 10**6)}", rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, t long").repartition(7)
    got = {r.id: (r["rank"], r["upto"]) for r in global_order(df, ["id"], {"upto": "t"}).collect()}
    total = 0
    for n, (key, t) in enumerate(sorted(rows), 1):
        total += t
        assert got[key] == (n, total)


@pytest.mark.parametrize("ranges", [2, 3, 64, 1024])
def test_running_totals_equal_a_sort(spark, ranges):
    rng = random.Random(2)
    rows = [(f"c{i % 7}:{rng.randint(0, 10**6)}", i, rng.randint(0, 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, n long, t long").repartition(7)
    got = {(r.id, r.n): (r["rank"], r["upto"]) for r in running_totals(df, ["id", "n"], {"upto": "t"}, ranges).collect()}
    total = 0
    for n, (key, i, t) in enumerate(sorted(rows), 1):
        total += t
        assert got[key, i] == (n, total)
    assert running_totals(df.limit(0), ["id"], {"upto": "t"}, ranges).count() == 0


def test_repeated_and_null_keys_are_numbered_once(spark):
    rows = [(k, 1) for k in ["a"] * 40 + ["b"] * 5 + [None] * 7 + ["c"]]
    got = running_totals(spark.createDataFrame(rows, "id string, t long"), ["id"], {"upto": "t"}, 8).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 54)) and all(r["rank"] == r.upto for r in got)
    order = [r.id for r in sorted(got, key=lambda r: r["rank"])]
    assert order == [None] * 7 + ["a"] * 40 + ["b"] * 5 + ["c"]


def test_a_budgeted_run_is_planned_without_a_job(spark):
    jobs = spark.createDataFrame([(f"a:{k:03}", "heuristic") for k in range(300)], "id string, extraction_source string")
    replies = spark.createDataFrame([(f"a:{k:03}", True, 1000, 10) for k in range(300)], "job_id string, ok boolean, prompt_tokens int, completion_tokens int")
    context = spark.sparkContext
    context.setJobGroup("planning", "nothing should run")
    try:
        plan = rebuild.cost_ceiling(jobs, replies, 10, None, 0.1)
        plan._jdf.queryExecution().optimizedPlan()
        assert list(context.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    done = {r.id: (r["rank"], r.done) for r in plan.collect()}
    # 0.00208 a call: the 49th passes the ceiling, so the fifth batch is the last one done.
    assert all(done[f"a:{k:03}"] == (k + 1, k < 50) for k in range(300))
