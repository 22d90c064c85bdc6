import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobstrata.functions import extraction, pay, remote, scoring, skills, text, urls
from jobstrata.operators import plugins
from jobstrata.operators.guards import is_anonymous
from tests.helpers import NOW, days_ago, explain


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalisation_is_unicode_aware(spark):
    values = ["  Sr.  Café Engineer (m/w)\x1c ", None, "　"]
    assert each(spark, values, text.normalize_text) == ["sr. café engineer (m/w)", "", ""]
    titles = ["Sr. LLM Engineer", "Sr LLM  Engineer", "---", "Ingénieur/e", "a_b²"]
    assert each(spark, titles, text.normalize_title) == [
        "sr llm engineer", "sr llm engineer", "", "ingénieur e", "a_b²",
    ]


def test_hash_ignores_case_and_spacing_only(spark):
    h = lambda t, d: one(spark, text.content_hash(F.lit(t), F.lit(d)))
    assert h("A b", "x  Y") == h("a  B ", " X y") != h("a b", "x y.")


def test_markup_in_both_encodings(spark):
    raw = [
        "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;&lt;ul&gt;&lt;li&gt;One&lt;/li&gt;&lt;/ul&gt;",
        "<p>a</p><p>b<br/>c</p>\n\n\n&eacute;&#8364;",
        None,
        "<P>x</P><br class='y'>z",
        "AT&T &amp;copy; 2",
    ]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r["o"] for r in text.with_plain_text(rows, "v", "o").orderBy("i").collect()]
    assert got == ["Hi & bye\n\n• One", "a\n\nb\nc\n\né€", "", "xz", "AT&T © 2"]


def test_each_step_of_the_markup_is_worked_out_once(spark):
    rows = spark.createDataFrame([("<p>a</p>",)], "v string").repartition(1)
    plan = text.with_plain_text(rows, "v", "o")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</p>") == 1 and plan.count("&nbsp;") == 2


def test_dates(spark):
    iso = ["2024-05-01T10:00:00Z", "2024-05-01T10:00:00+02:00", "2024-05-01", "soon", "", None, "2024-13-01"]
    got = each(spark, iso, lambda c: F.date_format(text.parse_iso(c), "MM-dd HH:mm"))
    assert got == ["05-01 10:00", "05-01 08:00", "05-01 00:00", None, None, None, None]
    ms = ["1714557600000", "0", "x", None]
    got = each(spark, ms, lambda c: F.date_format(text.parse_epoch_ms(c), "MM-dd HH:mm"))
    assert got == ["05-01 10:00", None, None, None]


@pytest.mark.parametrize(
    ("vendor", "url", "fallback", "embed"),
    [
        ("greenhouse", "https://boards.greenhouse.io/acme/jobs/123", False, False),
        ("greenhouse", "https://job-boards.greenhouse.io/acme/jobs/123?x=1", False, False),
        ("greenhouse", "https://acme.com/careers?gh_jid=123", True, True),
        ("greenhouse", "https://boards.greenhouse.io/embed/job_app?for=acme&token=123", True, False),
        ("lever", "https://jobs.lever.co/acme/123/apply", False, False),
        ("lever", "https://JOBS.lever.co/acme", True, False),
        ("lever", "https://jobs.lever.co:443/acme/123", True, True),
        ("ashby", None, True, False),
        ("ashby", "not a url", True, False),
    ],
)
def test_apply_links(spark, vendor, url, fallback, embed):
    got = one(spark, urls.resolve_apply(F.lit(vendor), F.lit("acme"), F.lit("123"), F.lit(url).cast("string")))
    assert (got["used_fallback"], got["is_embed"]) == (fallback, embed)
    assert "123" in got["url"] and (fallback or got["url"] == url)


def test_job_keys_split_at_the_first_colon(spark):
    assert each(spark, ["acme:1:2", "acme:", "acme:a\nb"], urls.ats_job_id) == ["1:2", "", "a\nb"]


def test_skill_vocabulary(spark):
    found = lambda c: F.array_join(skills.skills_in(skills.lowered_text(c)), ",")
    values = [
        "We use Python, Go and K8s", "goals, algorithms, rags", "Émigo go-to", "éml mlé", "TCP/IP; Node.js and nodejs",
        "javascript only", "C++ / retrieval-augmented", "Vector store, kernel programming, embedding",
    ]
    assert each(spark, values, found) == [
        "python,go,k8s", "", "go", "", "node,networking", "javascript", "c++,rag", "vector-db,cuda-kernels",
    ]
    many = "python rust golang typescript javascript java scala ruby elixir kotlin swift sql k8s docker"
    assert len(each(spark, [many], found)[0].split(",")) == 12


def test_canonical_skills(spark):
    tags = [["Kubernetes ", "K8S", "", "LLMs", "rust"], None]
    assert each(spark, tags, skills.canonical_skills, "array<string>") == [["k8s", "llm", "rust"], []]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("Pay $180,000 - $240,000 a year", (180000, 240000, "USD")),
        ("$180k–$240k", (180000, 240000, "USD")),
        ("€90k to €120k", (90000, 120000, "EUR")),
        ("180-240k", (180, 240000, None)),
        ("USD 180000 to 240000", (None, None, None)),
        ("10 - 20 people, then $100k — $150k", (100000, 150000, "USD")),
        ("$240k - $180k", (None, None, None)),
        ("180.000 - 240.000", (None, None, None)),
        ("90 to 95k GBP", (90, 95000, None)),
        (None, (None, None, None)),
    ],
)
def test_salary_from_text(spark, body, expected):
    got = one(spark, pay.pay_from_text(F.lit(body).cast("string")))
    assert (tuple(got) if got else (None, None, None)) == expected


def test_salary_arguments(spark):
    values = ["600000", "60w", "60万", "600k", "1.5m", "1,200", "lots", None]
    assert each(spark, values, pay.parse_salary_argument) == [600000, 600000, 600000, 600000, 1500000, 1200, None, None]


def test_remote_policy_phrases_are_case_sensitive(spark):
    resolve = lambda c: remote.resolve_remote(F.lit("unknown"), F.lit("Berlin"), c)
    values = ["is fully remote.", "Fully remote", "remote-first", "a hybrid role", "Hybrid", "on-site", "in office", "website"]
    assert each(spark, values, resolve) == ["remote", "unknown", "remote", "hybrid", "unknown", "onsite", "onsite", "unknown"]
    assert one(spark, remote.resolve_remote(F.lit("onsite"), F.lit("Remote"), F.lit("fully remote"))) == "onsite"
    assert one(spark, remote.resolve_remote(F.lit(None), F.lit("Remote, US"), F.lit(""))) == "remote"


@pytest.mark.parametrize(
    ("policy", "location", "scope", "regions"),
    [
        ("remote", None, "worldwide", []),
        ("remote", " Remote ", "worldwide", []),
        ("remote", "Remote - EMEA", "region_locked", ["EMEA"]),
        ("remote", "Remote, Europe", "region_locked", ["EU", "Europe"]),
        ("remote", "Remote - Germany or Canada", "country_locked", ["Canada", "Germany"]),
        ("remote", "Japan", "region_locked", ["APAC"]),
        ("remote", "Remote, US", "worldwide", []),
        ("remote", "Anywhere in Europe", "worldwide", []),
        ("hybrid", "Remote", None, []),
        (None, "Remote", None, []),
    ],
)
def test_remote_scope(spark, policy, location, scope, regions):
    got = one(spark, remote.remote_scope(F.lit(policy).cast("string"), F.lit(location).cast("string")))
    assert (got["scope"], got["regions"]) == (scope, regions)


@pytest.mark.parametrize(
    ("relists", "days", "expected"),
    [(0, 0.0, 0.0), (0, 45.0, 0.0), (0, 90.0, 0.25), (0, 135.0, 0.5), (1, 0.0, 0.15), (2, 90.0, 0.55), (7, 0.0, 1.0), (-3, 0.0, 0.0)],
)
def test_ghost_score(spark, relists, days, expected):
    assert one(spark, scoring.ghost_score(F.lit(relists), F.lit(days))) == pytest.approx(expected)


def test_scores_are_monotone_and_bounded(spark):
    rows = spark.range(0, 400).select(
        scoring.ghost_score(F.lit(1), F.col("id").cast("double")).alias("g"),
        scoring.freshness(F.lit(NOW) - F.make_dt_interval(days=F.col("id").cast("int")), F.lit(NOW)).alias("f"),
    ).collect()
    ghosts, fresh = [r["g"] for r in rows], [r["f"] for r in rows]
    assert ghosts == sorted(ghosts) and fresh == sorted(fresh, reverse=True)
    assert 0 <= min(ghosts + fresh) and max(ghosts + fresh) <= 1


def test_rank_depends_on_two_inputs_only(spark):
    assert scoring.rank_score.__code__.co_argcount == 2
    assert one(spark, scoring.rank_score(F.lit(2.0), F.lit(-1.0))) == pytest.approx(0.7)
    tags = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert one(spark, scoring.match_quality(tags("Rust", "rust", "go"), tags("RUST"))) == 0.5
    assert one(spark, scoring.match_quality(tags(), tags("x"))) == 1.0


def test_model_replies(spark):
    none = F.lit(None).cast("int")
    reply = '{"skills": ["Kubernetes", " ", "GO"], "remote_policy": "moon", "salary_min": 5, "salary_currency": "EUR"}'
    got = one(spark, extraction.clean_reply(F.lit(reply), F.lit(7), none, F.lit("").cast("string")))
    assert got.asDict() == {"skills": ["k8s", "go"], "remote_policy": "unknown", "salary_min": 7, "salary_max": None, "salary_currency": "EUR"}
    for bad in ("sorry", "[1]", ""):
        assert one(spark, extraction.clean_reply(F.lit(bad), none, none, F.lit(None).cast("string"))) is None


def test_key_points(spark):
    body = "About\n • " + "a" * 30 + "\n\n- " + "b" * 120 + "\nshort\n" + "c" * 25 + "\n" + "d" * 40
    assert one(spark, text.key_points(F.lit(body))) == ["a" * 30, "b" * 100 + "…", "c" * 25]


def test_anonymous_tokens(spark):
    values = ["#a3f9", "x" * 201, "a\nb", None, ""]
    assert each(spark, values, is_anonymous) == [True, False, False, False, True]


def test_file_names(spark):
    names = ["a.PY", "x.tar.gz", ".bashrc", "Makefile", "b.tsx", ".hidden.rs"]
    assert each(spark, names, skills.file_suffix) == [".py", ".gz", "", "", ".tsx", ".rs"]
    assert each(spark, names, skills.file_language) == ["python", None, None, None, "typescript", "rust"]


def test_timestamps_keep_true_instants(spark):
    from jobstrata.session import as_timestamp

    aware = dt.datetime(2024, 6, 1, 14, 0, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    same = spark.range(1).select((as_timestamp(aware) == as_timestamp("2024-06-01 12:00:00")).alias("v")).first()["v"]
    assert same and days_ago(0) == aware


def test_a_vocabulary_is_found_as_its_patterns_say(spark):
    """Simple patterns and others, beside accents, odd blanks, a dotless i and a long s; the text isn't searched once per tag."""
    texts = ["Gö go,GO!", "ago gopher", "ºgo", "élgo go_", "Tea\u017fs TEAM crewſ", "tıme", "time $5", "c++ C+", "node.js nodejs nodexjs", "", None, "K8S k8s", "a\u2003b"]
    vocabulary = {"go": [r"\bgo\b"], "time": ["tim[e]|TIDE"], "crew": ["team|crews"], "pay": [r"\$\d+"], "c": [r"c\+\+"], "node": [r"node\.?js"], "k": ["k8s"], "cap": ["[A-C]x|[T]EA"], "gap": [r"a\sb"]}
    got = each(spark, texts, lambda c: F.array_join(skills.skills_in(skills.lowered_text(c), vocabulary), ","))
    assert got == ["go", "", "", "", "crew,cap", "time", "time,pay", "c", "node", "", "", "k", "gap"]
    rows = spark.createDataFrame([("x",)], "v string").select(skills.lowered_text(F.col("v")).alias("v"))
    assert explain(rows.select(skills.skills_in(F.col("v")))).lower().count("contains(v") <= 2 * 60 * 2  # numbers of patterns only
    assert "RLIKE" not in explain(rows.select(skills.skills_in(F.col("v"))))


def test_blanks_collapse_and_pay_is_read_across_wide_ones(spark):
    texts = ["a b", "a  b", "a\tb", "a \t b", "a\t\tb\u2003 c", "\u3000a\u00a0\u2009b", "a’b – c", None]
    assert each(spark, texts, text.normalize_text) == ["a b", "a b", "a b", "a b", "a b c", "a b", "a’b – c", ""]
    ranges = ["$90k\u2003–\u2009$140k", "$90k – $140k", "90\u3000to\u3000120", "€50,000-60,000", "7-8", None]
    got = each(spark, ranges, lambda c: F.to_json(pay.pay_from_text(c)))
    assert got == ['{"min":90000,"max":140000,"currency":"USD"}'] * 2 + [None, '{"min":50000,"max":60000,"currency":"EUR"}', None, None]
    plan = explain(spark.createDataFrame([("x",)], "v string").select(pay.pay_from_text(F.col("v"))))
    assert plan.index("(?i)\\d[k") < plan.index("x00-")  # the first test reads the text as it is


def test_a_plug_in_gets_few_rows_at_once(spark):
    rows = spark.range(0, 3000, 1, 1).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("d").alias("description_raw"),
        *[F.lit(None).cast("string").alias(c) for c in ("location", "remote_hint")],
        *[F.lit(None).cast("int").alias(c) for c in ("salary_min", "salary_max")], F.lit(None).cast("string").alias("salary_currency"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    found = plugins.extract_with(rows, lambda: lambda posting: {"skills": [posting["title"]]})
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert found.filter("facts.skills[0] = 't'").select("id").distinct().count() == 3000
    frame = pd.DataFrame({"a": range(300)})
    assert [len(part) for part in plugins.in_steps(frame)] == [128, 128, 44]
