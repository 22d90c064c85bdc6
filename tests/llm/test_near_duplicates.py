import random
import re

import numpy as np
import pytest
from jobstrata.llm import near_duplicates as nd
from jobstrata.llm.components import components
from jobstrata.llm.shingles import alike, shingle_sets

from tests.llm.helpers import documents, postings, rows


def plain_sets(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(made):
    sets, ids = plain_sets([t for _, t in made]), [k for k, _ in made]
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(made)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    return sorted((k, len(s), root(k), root(k) == k) for k, s in zip(ids, sets))


def found(df):
    return rows(df, "id", "n_shingles", "component_id", "kept")


def edited(words, seed, changes):
    rng, out = random.Random(seed), list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{seed}x{k}"
    return " ".join(out)


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(300)] for _ in range(6)]
    made = [(None_ * 100 + k, edited(base[None_], k, k % 9)) for None_ in range(6) for k in range(20)]
    made += [(900, None), (901, ""), (902, " \n"), (903, "a b c"), (904, "A B\tc"), (905, "a b"), (906, "x " * 4000), (907, "X " * 5000), (908, " ".join(base[0]).upper())]
    assert found(nd.near_duplicates(postings(spark, *made))) == sorted(brute(made), key=repr)


def test_a_star_of_copies_is_one_group(spark):
    """The copies are alike to their original only, not to each other."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    made = [(500 + k, edited(base, k, 4)) for k in range(120)] + [(999, " ".join(base))]
    want = brute(made)
    assert found(nd.near_duplicates(postings(spark, *made))) == sorted(want, key=repr)
    assert sum(r[3] for r in want) < 3


def test_given_documents(spark):
    made = [(k, t) for k, t, *_ in documents("sf0.001")]
    assert found(nd.near_duplicates(postings(spark, *made))) == sorted(brute(made), key=repr)


def test_postings_without_an_id_are_kept(spark):
    jobs = postings(spark, (None, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (None, "a b c d e f"))
    assert found(nd.near_duplicates(jobs)) == sorted([(None, 2, None, True), (None, 2, None, True), (4, 2, 4, True), (5, 2, 4, False)], key=repr)
    assert nd.keep_first(jobs).count() == 3


def test_keep_first_keeps_columns(spark):
    jobs = postings(spark, (1, "a b c d e f"), (2, "a b c d e f"), (3, None))
    left = nd.keep_first(jobs)
    assert left.columns == jobs.columns and rows(left, "id", "text") == [(1, "other"), (3, "other")]
    assert nd.near_duplicates(postings(spark)).count() == 0


def test_large_regions_are_entered_deeper(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 10)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    made = [(k, edited(base, k, 1)) for k in range(150)]
    assert {r[2] for r in found(nd.near_duplicates(postings(spark, *made)))} == {0}


@pytest.mark.parametrize("salt", [20_000, 7])
def test_unlinked_sets_of_a_template_hide_no_near_copies(spark, monkeypatch, salt):
    """80 % of every text is shared, so any two are at 0.66; every tenth has a copy at 0.77, in whichever part of its region."""
    monkeypatch.setattr(nd, "REGION", 2)
    monkeypatch.setattr(nd, "SALT", salt, raising=False)
    rng = random.Random(6)
    template = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    made = [(k, " ".join(template + [f"own{k}x{j}" for j in range(40)])) for k in range(600)]
    made += [(1000 + k, " ".join(template + [f"own{k}x{j}" if j < 14 else f"new{k}x{j}" for j in range(40)])) for k in range(0, 600, 10)]
    want = brute(made)
    assert sum(not r[3] for r in want) == 60
    assert found(nd.near_duplicates(postings(spark, *made))) == sorted(want, key=repr)


def test_rare_shingles_bring_every_pair_between_groups(spark, monkeypatch):
    monkeypatch.setattr(nd, "SALT", 5)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    made = [(k, " ".join(base[:90 + k % 31]) if k % 5 == 0 else edited(base[:80 + k % 41], k, k % 6)) for k in range(90)]
    sets = list(shingle_sets([t for _, t in made]))
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 != j % 3 and alike(sets[i], sets[j], 75)}
    jobs = postings(spark, *made).selectExpr("id", "id % 3 known", "description_raw")
    got = {tuple(r) for r in nd.confirmed(nd.hot_pairs(jobs), jobs).collect()}
    assert len(want) > 50 and got == want


def _path(*values):
    out = 0
    for v in values:
        out = out << 16 | v
    return out


def test_neighbours_have_the_longest_common_prefix():
    rng = np.random.default_rng(3)
    path = np.sort(np.array([_path(*rng.integers(0, 3, 3)) for _ in range(60)]))
    for k in range(1, 59):
        longest = max(int(nd.common(path[k:k + 1], path[j:j + 1])[0]) for j in range(60) if j != k)
        assert longest == max(int(nd.common(path[k:k + 1], path[j:j + 1])[0]) for j in (k - 1, k + 1))
    assert nd.common(np.array([_path(1, 2, 3)]), np.array([_path(1, 2, 4)])).tolist() == [2]


def test_depth_follows_the_population():
    crowd = nd.CROWD + 1
    path = np.sort(np.array([_path(1, 1, 1)] * crowd + [_path(1, 1, 2)] * 3 + [_path(1, 2, k) for k in range(5)] + [_path(7, k, 0) for k in range(4)]))
    depth = nd.depths(path)
    assert depth[:crowd + 3].tolist() == [3] * (crowd + 3)  # more than CROWD share two values, and three
    assert depth[crowd + 3:crowd + 8].tolist() == [2] * 5 and depth[crowd + 8:].tolist() == [1] * 4
    assert nd.depths(path[-4:]).tolist() == [0] * 4  # a small region asks for nothing beyond its own prefix


@pytest.mark.parametrize("size", [3, 40, 700])
def test_forests_reach_every_copy(size):
    """Near copies of one text over all trees: their orders differ, and together the forests join all of them."""
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 16, nd.TREES * nd.DEPTH)
    signed = np.tile(base, (size, 1))
    for k in range(size):
        at = rng.choice(len(base), 12, replace=False)
        signed[k, at] = rng.integers(0, 1 << 16, 12)
    region, path = nd._places(signed.astype(np.uint16))
    parent, edges = list(range(size)), 0

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for t in range(nd.TREES):
        for r in np.unique(region[:, t]):
            members = np.flatnonzero(region[:, t] == r)
            if len(members) < 2:
                continue
            members = members[np.argsort(path[members, t], kind="stable")]
            found = nd.neighbours(path[members, t], (signed[members] & 15).astype(np.uint8), np.full(len(members), 100))
            assert len(found) < len(members)
            edges += len(found)
            for a, b in found:
                parent[root(members[a])] = root(members[b])
    assert len({root(k) for k in range(size)}) == 1 and edges <= nd.TREES * size


def test_second_pass_takes_all_pairs_between_groups():
    bits = np.zeros((5, nd.TREES * nd.DEPTH), np.uint8)
    pairs = nd.unjoined(bits, np.full(5, 10), np.array([1, 1, 1, 2, 3]))
    assert {tuple(sorted(p)) for p in pairs} == {(0, 3), (1, 3), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4)} and len(pairs) == 7
    assert nd.unjoined(bits, np.full(5, 10), np.array([1, 1, 1, 1, 1])) == []


def test_dense_regions_meet_by_full_sets(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    made = [(k, edited(base, k, 5 + k % 6)) for k in range(150)]
    monkeypatch.setattr(nd, "DENSE", 0)
    assert nd.unjoined(np.zeros((4, 8), np.uint8), np.full(4, 9), np.arange(4)) is None
    sets = list(shingle_sets([t for _, t in made]))
    links = nd.joins(sets, np.arange(150))
    want = brute(made)
    assert len(links) == 150 - sum(r[3] for r in want) and all(alike(sets[a], sets[b], 75) for a, b in links)
    jobs = postings(spark, *made).select("id", "description_raw")
    members = jobs.selectExpr("cast(1 as long) key", "id", "id known")
    got = dict(rows(components(nd.dense_links(members, jobs)), "id", "component"))
    assert all(got.get(k, k) == c for k, _, c, _ in want)


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1003, 1001), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1003: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(60_000))
    one = next(shingle_sets([text]))
    monkeypatch.setattr("jobstrata.llm.shingles._CHUNK", 5000)
    two = list(shingle_sets(["a b c d e", text, "a b c d e"]))
    assert (one == two[1]).all() and alike(two[0], two[2], 100) and len(one) == len(plain_sets([text])[0])


def test_texts_meet_ids_by_the_same_join_at_any_size(spark):
    texts = spark.createDataFrame([(k, "a b c d e f") for k in range(3)], "id long, description_raw string")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    found = nd.confirmed(pairs, texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1), (1, 2)]
