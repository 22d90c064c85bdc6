import re

import pytest
from jobstrata.llm.mixing import Mix, layout, mixed_sizes, mixed_texts, mixture, permuted, shard_counts, slots
from pyspark.sql import functions as F

from tests.llm.helpers import documents, postings, rows


def filled(sizes, total, weights):
    """Targets by sharing the excess again until no source is above its cap."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        shares = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            return target | shares
        open_ -= over
    return target


@pytest.fixture(scope="module")
def corpus():
    return [(k, t, None, None if s == "src3" else s) for k, t, _, s in documents("sf0.001")]


def test_sources_come_near_their_targets(spark, corpus):
    got = mixed_sizes(postings(spark, *corpus)).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, *_ in corpus}
    of = {k: s for k, _, _, s in corpus}
    sizes = {}
    for k, s in of.items():
        sizes[s] = sizes.get(s, 0) + size[k]
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    want = filled(sizes, 1.5 * sum(sizes.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r.id] and r.source_size == sizes[of[r.id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[of[r.id]])
        taken[of[r.id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 64 for s in sizes)
    assert got and sorted(got) == sorted(mixed_sizes(postings(spark, *corpus)).collect())


def test_mixture_rows_are_what_sizes_count(spark, corpus):
    jobs = postings(spark, *corpus)
    found = mixture(jobs)
    by = dict(rows(found.groupBy("id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")), "id", "n"))
    assert by == {r.id: r.taken for r in mixed_sizes(jobs).collect() if r.taken}
    numbers = sorted(r.slot for r in found.select("slot").distinct().collect())
    assert numbers == list(range(len(numbers)))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        found = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in found) == list(range(n))


def test_a_large_permutation_keeps_within_bounds_and_shifts_differ(spark):
    n = 10**13
    some = spark.range(1000).select(*[permuted(F.col("id") * 7919, F.lit(n), F.lit(shift).cast("long")).alias(f"p{shift}") for shift in (1, 2)]).collect()
    for name in ("p1", "p2"):
        values = [r[name] for r in some]
        assert len(set(values)) == 1000 and 0 <= min(values) < n // 50 and n - n // 50 < max(values) < n
    assert not any(r.p1 == r.p2 for r in some)
    # No fixed step from one index to the next, as an affine map would have.
    steps = {(b.p1 - a.p1) % n for a, b in zip(some, some[1:])}
    assert len(steps) > 900


def test_shards_draw_their_sources(spark):
    """Counts of a source per shard vary as those of a multinomial draw with fixed totals, and totals are exact."""
    size, shards = 256, 240
    total = size * shards
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    made = [(s, k, int(total * p), int(total * p) // 2 + 1) for k, (s, p) in enumerate(share.items())]
    sources = spark.createDataFrame(made, "source string, place int, draws long, blocks long")
    counts = {}
    for r in shard_counts(slots(sources, Mix(shard_slots=size))).collect():
        counts.setdefault(r.source, []).append(r.n)
    for s, p in share.items():
        assert sum(counts[s]) == int(total * p)
        seen = counts[s] + [0] * (shards - len(counts[s]))
        variance = sum((n - size * p) ** 2 for n in seen) / shards
        expected = size * p * (1 - p) * (1 - 1 / shards)
        assert 0.7 * expected < variance < 1.4 * expected, (s, variance, expected)


def test_odd_rows(spark):
    jobs = postings(spark, (1, None, None, "a"), (2, "", None, None), (3, "one two", None, "a"), (3, "one two", None, "a"), (4, "x " * 3000, None, None), (None, "lost words", None, "b"))
    got = mixed_sizes(jobs).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r["size"] for r in got)
    assert {(r.id, r["size"]) for r in got} == {(1, 0), (2, 0), (3, 2), (4, 3000), (None, 2)}
    assert mixed_sizes(postings(spark)).count() == 0
    assert mixed_sizes(postings(spark, (1, None), (2, " "))).filter("taken = 0").count() == 2


def test_texts_hold_the_words_taken(spark, corpus):
    jobs = postings(spark, *corpus, (7, corpus[7][1], None, corpus[7][3]))
    mixed = mixed_texts(jobs)
    assert mixed.columns == jobs.columns
    got = {}
    for r in mixed.collect():
        got[r.id] = got.get(r.id, 0) + len(r.description_raw.split())
        assert r.text == "other"
    sizes = mixed_sizes(jobs).groupBy("id").agg(F.sum("taken").alias("n")).filter("n > 0")
    assert sum(got.values()) == sizes.agg(F.sum("n")).first()[0]
    whole = {k: t for k, t, *_ in corpus}
    full = [r for r in mixed.collect() if len(r.description_raw.split()) == len(whole[r.id].split())]
    assert full and all(r.description_raw == whole[r.id].rstrip() for r in full)


def test_layout_needs_no_source_in_one_task(spark, corpus):
    rows_, _ = layout(postings(spark, *corpus), Mix())
    spans = sorted((r.source, r.begin, r.end) for r in rows_.filter("source is not null").collect())
    for (s, _, e), (t, b, _) in zip(spans, spans[1:]):
        assert s != t or b == e
