import random

import numpy as np
import pytest
from jobstrata.llm import repeated_spans
from jobstrata.llm.repeated_spans import _later, LENGTH, remove_repeats, runs
from jobstrata.llm.suffix_sort import Suffixes, classes

from tests.llm.helpers import documents, postings


def brute(made):
    """(id, bytes, removed spans, kept) by a set of all strings seen before, in id order."""
    seen, out = {}, []
    for k, text in sorted(made, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, np.int8)
        for p in range(len(data) - LENGTH + 1):
            if seen.setdefault(data[p:p + LENGTH], (k, p)) != (k, p):
                gone[p + 1:p + LENGTH + 1] = 1
        edges = np.flatnonzero(np.diff(gone))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((k, len(data), spans, bytes(b for b, g in zip(data, gone[1:]) if not g)))
    return out


def found(df):
    return sorted((r.id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect())


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "été", "rust", "data", "and"]) + str(rng.randrange(50)) for _ in range(n))


LINE = "Equal opportunity employer, all applicants are welcome here. "  # shorter than LENGTH, but holds a minimiser
CASES = [
    None, "", "short", prose(1, 60), prose(1, 60), "x" + prose(1, 60), prose(2, 40) + prose(1, 60)[:150] + prose(3, 40), "ab" * 400, "ab" * 300 + "c" + "ab" * 300,
    "é" * 200, "y" * 99, "y" * 100, "y" * 101, prose(4, 30) + LINE + prose(5, 30), prose(6, 30) + LINE + prose(7, 30), prose(6, 30) + LINE + prose(8, 30), prose(9, 4000), prose(9, 4000)[5000:],
]


@pytest.mark.parametrize("hot_runs", [2000, 1])
def test_spans_agree_with_brute_force(spark, hot_runs):
    made = list(enumerate(CASES))
    assert found(remove_repeats(postings(spark, *made), hot_runs)) == brute(made)


def test_a_hot_passage_is_sent_once_a_batch(spark, monkeypatch):
    """The passage's neighbours differ in every posting, so no run is equal as a whole."""
    passage = prose(20, 30)[:150]
    made = [(k, prose(100 + k, 12) + passage + prose(900 + k, 12)) for k in range(300)]
    sent, sort = [], repeated_spans.sort_open_runs
    monkeypatch.setattr(repeated_spans, "sort_open_runs", lambda opened, kind: sent.append(opened) or sort(opened, kind))
    jobs = postings(spark, *made, made[7])
    assert found(remove_repeats(jobs, 1)) == sorted([*brute(made), brute(made)[7]])
    copies = {}
    for r in sent[0].collect():
        at = 0
        for n in r.strings if r.data is not None else []:
            for j in range(n):
                string = bytes(r.data[at + j:at + j + LENGTH])
                copies[string] = copies.get(string, 0) + 1
            at += n + LENGTH - 1
    assert max(n for s, n in copies.items() if s in passage.encode()) <= 16


def test_given_documents(spark):
    made = [(k, t) for k, t, *_ in documents("sf0.001")]
    assert found(remove_repeats(postings(spark, *made))) == brute(made)


def test_repeated_rows_count_once_and_string_ids_work(spark):
    text = prose(11, 80)
    jobs = postings(spark, (5, text), (5, text), (6, text), (None, "z" * 10))
    got = remove_repeats(jobs).collect()
    assert sorted(len(r.kept) for r in got) == sorted([len(text.encode())] * 2 + [0, 10])
    named = jobs.selectExpr("cast(id as string) id", "description_raw")
    assert sorted(len(r.kept) for r in remove_repeats(named).collect()) == sorted([len(text.encode())] * 2 + [0, 10])
    assert remove_repeats(postings(spark)).count() == 0


def test_very_long_text_is_cut_into_pieces():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    m, r, q, start, strings = runs(data, np.array([1000, 3000]))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(start, strings)])
    assert covered.tolist() == [*range(901), *range(1000, 2901)]


def test_long_text_across_chunks(spark):
    body = "".join(random.Random(5).choices("abcdefgh ", k=1_300_000))
    got = found(remove_repeats(postings(spark, (1, body), (2, body[400_000:1_200_000]), (3, body[1_048_300:1_048_700]))))
    assert [r[2] for r in got] == [[], [(0, 800_000)], [(0, 400)]]


def test_suffix_order_is_exact():
    rng = random.Random(1)
    for _ in range(20):
        data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
        at = np.array(sorted(rng.sample(range(380), 200)))
        group = np.sort(np.array([rng.randrange(4) for _ in at]))
        order, number = classes(data, at, group, 12)
        key = [(group[k], bytes(data[at[k]:at[k] + 12]), k) for k in range(len(at))]
        assert order.tolist() == [k[2] for k in sorted(key)]
        ranked = [key[k][:2] for k in order]
        assert all((a == b) == (x == y) for a, b, x, y in zip(ranked, ranked[1:], number, number[1:]))


def test_common_extension():
    data = np.frombuffer(b"abcabcabd" + b"z" * 9, np.uint8)
    assert Suffixes(data, 6).common(np.array([0, 0, 1]), np.array([3, 1, 4])).tolist() == [5, 0, 4]


def test_false_hash_equality_is_caught(monkeypatch):
    tried = []

    class Weak(Suffixes):
        def __init__(self, data, limit, seed=101):
            super().__init__(data, limit, seed)
            tried.append(seed)
            if len(tried) == 1:
                self.sums = np.zeros_like(self.sums)  # every comparison looks equal

    monkeypatch.setattr("jobstrata.llm.suffix_sort.Suffixes", Weak)
    data = np.frombuffer(b"dcba" * 5, np.uint8)
    order, _ = classes(data, np.arange(8), np.ones(8, int), 4)
    assert len(tried) == 2 and [bytes(data[k:k + 4]) for k in order] == sorted(bytes(data[k:k + 4]) for k in range(8))


def test_runs_are_equal_only_if_both_hashes_agree():
    m, r, q = (np.array(v, np.uint64) for v in ([5, 5, 5, 5], [1, 1, 1, 1], [7, 7, 8, 8]))
    by, later = _later(m, r, q, np.array([1, 2, 3, 3]), np.array([0, 0, 0, 0]))
    assert dict(zip(by.tolist(), later.tolist())) == {0: False, 1: True, 2: False, 3: False}  # the last two are one row, repeated
