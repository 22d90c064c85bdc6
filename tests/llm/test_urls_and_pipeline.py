import os

import corpus_pipeline
import pytest
from jobstrata.llm.queries import QUERIES, as_documents, as_postings
from jobstrata.llm.url_filter import Rule, host_edges, judge_urls, spread_trust, url_host, url_path
from pyspark.sql import functions as F

from tests.llm.helpers import rows

RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]


def pages(spark, *made):
    return spark.createDataFrame([(k, u, h, "x") for k, u, h in made], "id long, careers_url string, description_raw string, host string")


def test_hosts_paths_and_longest_rule(spark):
    made = [
        (1, "http://A.Example.ORG/es/x?q#f", None), (2, "https://example.org/en/12", ""), (3, "x.example.org/en/1", None), (4, None, None), (5, "HTTP://shop.com#/fr/", None),
        (6, "http://com/fr/1", None), (7, "http://acme.com/de/", None), (8, "http://myexample.org/es/", None), (9, "http://u://v/w", None), (9, "http://u://v/w", None), (10, "http://É.org", None),
    ]
    got = rows(judge_urls(pages(spark, *made), RULES), "id", "host", "path", "rule", "verdict")
    assert got == sorted([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "shop.com", "", None, "allow"), (6, "com", "/fr/1", "com/fr/", "allow"), (7, "acme.com", "/de/", "com/de/", "block"), (8, "myexample.org", "/es/", "org/", "allow"),
        (9, "u:", "//v/w", None, "allow"), (9, "u:", "//v/w", None, "allow"), (10, "É.org", "", None, "allow"),
    ], key=repr)
    assert judge_urls(pages(spark), RULES).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    made = [
        (1, "http://good.org/", '<a href="http://friend.net/a">x</a>'), (2, "http://bad.com/de/", "<a href='/own'>"), (3, "http://lure.net/", "<A HREF=//bad.com/de/ >"),
        (4, "http://friend.net/", None), (5, "http://m.bad.com/", ""), (6, "http://lone.net/", "href="),
    ]
    got = dict(rows(judge_urls(pages(spark, *made), RULES), "id", "verdict"))
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


def test_ranks_agree_with_a_plain_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "a", 3)]
    seeds = {"a": (3.0, 0.0), "c": (0.0, 2.0), "e": (1.0, 1.0)}
    t, d = ({h: seeds.get(h, (0, 0))[k] for h in "abcde"} for k in (0, 1))
    t0, d0 = dict(t), dict(d)
    for _ in range(8):
        t, d = (
            {h: 0.15 * t0[h] + sum(0.85 * t[s] * w / sum(x for q, _, x in edges if q == s) for s, e, w in edges if e == h) for h in t},
            {h: 0.15 * d0[h] + sum(0.85 * d[e] * w / sum(x for _, q, x in edges if q == e) for s, e, w in edges if s == h) for h in d},
        )
    got = spread_trust(spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, weight long"))
    assert {r.host: (r.trust, r.distrust) for r in got.collect()} == {h: (pytest.approx(t[h], abs=1e-8), pytest.approx(d[h], abs=1e-8)) for h in t}


def test_edges_between_hosts_and_parents(spark):
    made = pages(spark, (1, "http://m.a.com/", '<a href="https://b.net/x"><a href="https://b.net/y">'), (2, "http://a.com/", "/rel"), (3, "http://x.y.a.com/", None))
    placed = made.select(url_host(F.col("careers_url")).alias("host"), url_path(F.col("careers_url")).alias("path"), "description_raw")
    assert rows(host_edges(placed, placed.select("host").distinct()), "src", "dst", "weight") == sorted([
        ("m.a.com", "b.net", 2), ("m.a.com", "a.com", 1), ("x.y.a.com", "a.com", 1),
    ], key=repr)


def test_names_of_other_columns_survive(spark):
    docs = spark.createDataFrame([(1, "t", "en", "s", "x", "y")], "doc_id long, text string, lang string, source string, id string, description_raw string")
    assert as_documents(as_postings(docs)).collect() == docs.collect() and as_postings(docs).columns[:4] == ["id", "description_raw", "language", "source"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_the_given_tables(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name == "op12_filter_audit":  # a row per part, order of the five filters and step
        parts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("source", F.lit(""))).distinct().count()
        assert found.count() == parts * 120 * 5
        return
    keys = {"page_id", "doc_id"} & set(found.columns)
    given = "pages" if "page_id" in keys else "documents"
    want = spark.read.parquet(f"/root/testdata/sf0.001/{given}.parquet").count()
    assert keys and found.count() == want


def small(spark, folder, docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_do_what_their_operators_say(spark, tmp_path):
    from jobstrata.llm.decontaminate import contamination
    from jobstrata.llm.mixing import mixed_sizes
    from jobstrata.llm.near_duplicates import near_duplicates
    from jobstrata.llm.quality_classifier import score_quality

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]

    def step(name, given):
        path = os.path.join(tmp_path, name.split()[0])
        stages[name](spark, given, sf).write.parquet(path)
        return spark.read.parquet(path)

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = step("quality classifier", docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_quality(as_postings(docs), labels.withColumnRenamed("doc_id", "id"))
    assert good.columns == docs.columns and ids(good) == sorted(r.id for r in scored.filter("predicted = 1").collect()) and good.join(labels, "doc_id").filter("quality = 0").count() == 0
    first = step("MinHash near-dedup", good)
    assert first.columns == docs.columns and ids(first) == sorted(r.id for r in near_duplicates(as_postings(good)).filter("kept").collect())
    clean = step("benchmark decontamination", first)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert clean.columns == docs.columns and ids(clean) == sorted(r.id for r in contamination(as_postings(first), bench).filter("not contaminated").collect()) and clean.count() < first.count()
    mixed = step("mixing sources to target weights", clean)
    taken = {r.id: r.taken for r in mixed_sizes(as_postings(clean)).collect() if r.taken}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert mixed.columns == docs.columns and words == taken
    last = step("token-ID / binary output", mixed)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and ids(last) == ids(mixed)


def test_pipeline_with_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("id", F.lit("x")).withColumn("description_raw", F.lit(1))
    odd = spark.createDataFrame([(90001, None, None, None, None, "x", 1), (90002, "", "en", None, 0, "x", 1), (90003, "a b", None, "", 3, "x", 1), (90003, "a b", None, "", 3, "x", 1)], docs.schema)
    found = corpus_pipeline.run(spark, small(spark, tmp_path / "odd", docs.union(odd)))
    assert found.count() > 0
    assert corpus_pipeline.run(spark, small(spark, tmp_path / "none", docs.limit(0))).count() == 0
