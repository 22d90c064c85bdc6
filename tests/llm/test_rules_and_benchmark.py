import re
import time
from collections import Counter

import pytest
from jobstrata.llm import decontaminate, oracle
from jobstrata.llm.decontaminate import contamination, cut_passages, remove_contaminated
from jobstrata.llm.quality_rules import Limits, _rates, bucket_of, judge_quality, limits_of, measures, sketches
from pyspark.sql import functions as F

from tests.llm.helpers import postings, rows


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c", "a b c a b c", "a a a a", "x y\nx y\n\n x y\nx y", "é#*$ %&|<>\x0b\x0cq  r", "w " * 60,
    " ".join(f"w{k % 37}" for k in range(300)), " ".join(f"v{k}" for k in range(5000)) + " v1 v2 v3", "a b c d a b x c d a b c",
]


def test_counts_agree_with_a_plain_count(spark):
    found = judge_quality(postings(spark, *[(k, t, "en", "s") for k, t in enumerate(TEXTS)], (3, "one", "en", "s")))
    got = rows(found, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(k, *counts(t)) for k, t in [*enumerate(TEXTS), (3, "one")]]
    assert got == sorted([(*w, w[1] < 50 or 100 * w[5] > 50 * w[1]) for w in want], key=repr)


def test_limits_follow_the_group(spark):
    plain = " ".join(f"word{k}" for k in range(60))
    marked = " ".join(f"word{k}#" for k in range(60))
    made = [(k, plain, "en", "prose") for k in range(30)] + [(99, marked, "en", "prose"), (98, plain, None, None)]
    made += [(100 + k, marked, "en", "code") for k in range(30)]
    kept = dict(rows(judge_quality(postings(spark, *made), Limits(min_rows=10)), "id", "kept"))
    assert not kept[99] and kept[100] and kept[0] and kept[98] is True


def test_repeated_lines_are_judged_by_their_source(spark):
    """Where no text repeats a line the limit is low, where most do it is high; symbols alike."""
    def text(k, repeats, symbols=0):
        lines = [" ".join(f"w{k}x{i}y{j}" for j in range(10)) + " #" * (i < symbols) for i in range(10)]
        return "\n".join(lines + lines[:repeats])

    made = [(k, text(k, 0), "en", "never") for k in range(200)] + [(200 + k, text(k, k % 4, 5), "en", "often") for k in range(200)]
    made += [(900, text(900, 3), "en", "never"), (901, text(901, 3, 5), "en", "often"), (902, text(902, 0, 5), "en", "never")]
    jobs = postings(spark, *made)
    rates = measures(jobs).withColumns(_rates(Limits()))
    found = {r.source: r for r in limits_of(sketches(rates)).collect()}
    assert found["never"].max_dup_line_rate < 20 and found["often"].max_dup_line_rate > 200
    assert found["never"].max_symbol_rate < 15 and found["often"].max_symbol_rate > 40
    kept = dict(rows(judge_quality(jobs), "id", "kept"))
    assert not kept[900] and kept[901] and not kept[902] and kept[0] and kept[203]


def test_sketch_buckets_are_close_below(spark):
    found = spark.range(0, 40000, 7).select("id", bucket_of(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and (r.id - r.b) * 64 <= max(r.id, 1) for r in found)


def test_empty_tables_give_no_rows(spark):
    none = postings(spark)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert judge_quality(none).count() == 0
    assert contamination(none, benchmark).count() == 0


BENCHMARK = [(1, "alpha beta gamma delta"), (10, "One two three four five six seven eight nine ten eleven"), (2, "alpha beta gamma delta"), (3, None), (4, "--"), (5, "Été à")]


def brute(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[i:i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit)


DOCS = [
    None, "", "!!", "x alpha, BETA gamma delta beta gamma delta y", "alpha beta gamma", "one two three four five six seven eight nine ten",
    "zero one TWO three four five six seven eight nine ten eleven twelve", "ÉtÉ été à la", "alpha beta gamma delta alpha beta gamma delta", "w " * 20000 + "alpha beta gamma delta",
]


def test_passages_agree_with_brute_force(spark):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    jobs = postings(spark, *enumerate(DOCS), (3, DOCS[3]), (3, "clean"))
    got = rows(contamination(jobs, bench), "id", "n_words", "n_hit", "items", "contaminated")
    assert got == sorted([(k, *brute(t, BENCHMARK)) for k, t in [*enumerate(DOCS), (3, DOCS[3]), (3, "clean")]], key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_passages_across_stretches(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    texts = ["pad " * k + "alpha beta gamma delta " + "x " * 7 + "one two three four five six seven eight nine ten eleven" for k in (0, 1, 2, 5, 120, 127, 255)]
    for n in (10**6, 0):
        found = {r.id: (r.n_words, [tuple(h) for h in r.hits], r["items"]) for r in decontaminate.find_passages(postings(spark, *enumerate(texts)), bench, max_broadcast=n).collect()}
        for k, t in enumerate(texts):
            n_words, n_hit, items, _ = brute(t, BENCHMARK)
            assert found[k][0] == n_words and found[k][2] == items
            assert len({p for a, length in found[k][1] for p in range(a, a + length)}) == n_hit


def test_long_texts_take_no_longer_than_short_ones(spark):
    """A quarter of a million words in one text, and in 250."""
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    words = [f"w{k % 977}" for k in range(250_000)]
    took = []
    for size in (1000, 1000, 250_000):
        jobs = postings(spark, *[(k, " ".join(words[at:at + size])) for k, at in enumerate(range(0, len(words), size))]).coalesce(1)
        start = time.perf_counter()
        assert contamination(jobs, bench).agg(F.sum("n_words")).first()[0] == 250_000
        took.append(time.perf_counter() - start)
    assert took[2] < 3 * took[1] + 2, took


def test_shuffled_windows_give_the_same(spark):
    from jobstrata.llm.decontaminate import find_passages

    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    jobs = postings(spark, *enumerate(DOCS))
    one, other = (rows(find_passages(jobs, bench, max_broadcast=n), "id", "n_words", "hits", "items") for n in (10**6, 0))
    assert one == other


def test_removal_keeps_clean_postings_whole_and_cuts_spans(spark):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    jobs = postings(spark, *enumerate(DOCS), (None, "clean"), (None, "alpha beta gamma delta"))
    left = remove_contaminated(jobs, bench)
    assert left.columns == jobs.columns
    assert rows(left, "id", "text") == sorted([(k, "other") for k in (0, 1, 2, 4, 7)] + [(None, "other")], key=repr)
    cut = dict(rows(cut_passages(jobs, bench), "id", "description_raw"))
    assert cut[3] == "x beta gamma delta y" and cut[4] == "alpha beta gamma" and cut[0] is None


def test_empty_benchmark_leaves_all_clean(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows(contamination(postings(spark, (1, "a b")), bench), "id", "n_words", "contaminated") == [(1, 2, False)]


def test_twins_are_registered():
    assert {"op1_quality_rules", "op3_decontamination", "op10_mixing"} <= set(oracle.SQL)
