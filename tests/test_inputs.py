"""The postings and payloads that the registered queries are projected onto."""

from __future__ import annotations

import datetime as dt
import json

from jobstrata.plans import fixtures as X


def _tables(spark, root, orders=6):
    rows = [(k, k, "O", 1000.0 + k, dt.date(2000, 1, 1 + k % 9), "5-LOW") for k in range(orders)]
    given = {
        "orders": spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        "part": spark.createDataFrame([(k, f"part {k}") for k in range(orders)], "p_partkey long, p_name string"),
        "supplier": spark.createDataFrame([(k, f"s{k}", 1.0) for k in range(3)], "s_suppkey long, s_name string, s_acctbal double"),
        "documents": spark.createDataFrame([(0, "zero"), (1, "one"), (1, "one again")], "doc_id long, text string"),
    }
    for name, df in given.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_texts_are_shuffled_to_their_pages_and_nowhere_else(spark, tmp_path):
    root = _tables(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = X.landing(spark, root, "lever")
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert plan.index("collect_list") < plan.index("Exchange")
        found = {r["company_id"]: r for r in pages.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Orders 1 and 4 are of company 1; both meet both rows of document 1.
    assert list(found) == ["c1"] and found["c1"]["page_count"] == 1
    texts = [(job["id"], job["descriptionPlain"].split(". ")[-1]) for job in json.loads(found["c1"]["body"])]
    assert sorted(texts) == [(k, text) for k in "14" for text in ("one", "one again")]


def test_tasks_with_texts_grow_with_the_orders(spark, tmp_path, monkeypatch):
    root = _tables(spark, tmp_path, orders=60)
    monkeypatch.setattr(X, "TEXT_ROWS", 2)
    assert X._text_tasks(spark, root) == 30
    assert X.postings(spark, root, with_text=True).rdd.getNumPartitions() == 30


def test_a_page_of_one_posting_is_written_where_its_text_is(spark, tmp_path):
    root = _tables(spark, tmp_path, orders=6)
    # Orders 501 and 1001 are alone on their pages, 4 and 7 share one; document 2 is unknown.
    ids = [4, 7, 501, 1001, 503]
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4)] + [(5, None)], "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{root}/documents.parquet")
    rows = [(k, 1, "O", 1.0, dt.date(2000, 1, 1), "5-LOW") for k in ids]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string")
    orders.write.mode("overwrite").parquet(f"{root}/orders.parquet")
    pages = X.landing(spark, root, "lever")
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("page_size") > 1 and "Union" in plan
    found = {r["page_no"]: r for r in pages.collect()}
    in_feed = [k for k in ids if (k % 7 != 0 or k % 9 == 8) and k % 5 != 4]
    assert sorted(found) == sorted({k // 500 for k in in_feed})
    assert {r["page_count"] for r in found.values()} == {len(found)}
    for number, page in found.items():
        assert [job["id"] for job in json.loads(page["body"])] == [str(k) for k in in_feed if k // 500 == number]
