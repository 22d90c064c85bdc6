from itertools import permutations

import numpy as np
import pytest

from jobstrata.llm import word_transducer as wt
from jobstrata.llm.filter_audit import audit_filters, text_counts
from jobstrata.llm.word_transducer import count_texts, first_words

from tests.llm.helpers import documents, postings, rows

SPACE = " \t\n\x0b\x0c\r"


def plain_counts(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    text = text or ""
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


ODD = [
    None, "", " ", "\n", "a", " a ", "a\x0bb\x0cc\rd\te", "É É é 　 x y z", "😀😀 😀", "A#b $ % & * | < >", "x\0y \0", "same same Same",
    "abcdefgh abcdefgh abcdefghi abcdefghj abcdefghijklmnopqrst abcdefghijklmnopqrsu", "w " * 5000, "q" * 100_000,
]


def test_counts_equal_plain_ones():
    texts = ODD + [t for _, t, *_ in documents("sf0.001")]
    assert list(zip(*(c.tolist() for c in count_texts(texts)))) == [plain_counts(t) for t in texts]


def test_long_texts_go_piece_by_piece(monkeypatch):
    monkeypatch.setattr(wt, "_PIECE", 64)
    texts = ODD + ["a b " * 100, "ü" * 200, " " * 500, "A" * 65 + " b" + "C" * 63 + " " + "A" * 65, "x " * 31 + "é" * 64 + "\n" + "x" * 64, "n" * 64, "n" * 65 + " "]
    assert list(zip(*(c.tolist() for c in count_texts(texts)))) == [plain_counts(t) for t in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_equal_hashes_do_not_join_different_words(seed):
    """All words of all texts get one of three hashes; the table still tells them apart by their bytes."""
    draw = np.random.default_rng(seed)
    words = [["a", "bb", "abcdefgh", "abcdefghi", "abcdefghX", "abcdefghabcdefghY", "abcdefghabcdefghZ"][k] for k in draw.integers(0, 7, 300)]
    raws = [" ".join(words[k:k + 30]).encode() for k in range(0, 300, 30)]
    _, text, starts, ends, data = wt._pass(raws)
    hashes = np.array([len(bytes(data[a:b])) % 3 for a, b in zip(starts, ends)], np.uint64) << np.uint64(62)
    first = first_words(data, text, starts, ends, hashes=hashes)
    got = sorted((int(text[k]), bytes(data[starts[k]:ends[k]])) for k in first)
    assert got == sorted({(t, w) for t, raw in enumerate(raws) for w in raw.split()})


def plain_audit(made, marks):
    """made: (id, text, source); marks: id -> (quality, toxic). Filters applied one after another, order by order."""
    failed = []
    for id_, text, _ in made:
        words, distinct, capitals, points, symbols = plain_counts(text)
        twin = id_ is not None and any(i is not None and i < id_ and (t or "") == (text or "") for i, t, _ in made)
        failed.append({c for c, f in zip("ABCDE", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0, twin)) if f})
    out = {}
    for part in {s or "" for _, _, s in made}:
        docs = [(f, marks.get(i, (0, 0))) for f, (i, _, s) in zip(failed, made) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in alive if c in d[0]]
                alive = [d for d in alive if c not in d[0]]
                total[c] += len(gone)
                out[part, order, step] = [
                    len(alive), len(gone), sum(c in d[0] for d in docs) - len(gone), sum(d[0] == {c} for d in docs),
                    sum(d[1][0] == 1 for d in gone), sum(d[1][1] == 1 for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


COLUMNS = ("source", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_filters_applied_in_turn(spark):
    varied = " ".join(f"w{k}" for k in range(60))
    made = [
        (1, varied, "a"), (2, varied, "a"), (3, varied, "b"), (4, None, None), (5, "", "a"), (6, "A B C # x", "b"), (7, varied + " #", "a"),
        (8, "w " * 60, "a"), (8, "w " * 60, "a"), (9, "w " * 60, None), (None, varied, "a"), (None, "ONE", "b"), (1, varied, "a"), (10, varied.upper(), ""), (11, "x" * 400_000, "c"),
    ]
    marks = {2: (1, 0), 3: (0, 1), 6: (1, 1), 7: (1, 0), 8: (0, 1), 9: (1, None)}
    jobs = postings(spark, *[(i, t, "en", s) for i, t, s in made])
    labels = spark.createDataFrame([*[(i, q, t) for i, (q, t) in marks.items()], (3, 0, None), (None, 1, 1)], "id long, quality int, toxic int")
    found = rows(audit_filters(jobs, labels), *COLUMNS)
    assert found == sorted(plain_audit(made, marks), key=repr) and len(found) == 4 * 600


def test_audit_of_the_documents(spark):
    made = [(k, t, s) for k, t, _, s in documents("sf0.001")]
    jobs = postings(spark, *[(i, t, "en", s) for i, t, s in made])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumnRenamed("doc_id", "id")
    marks = {r["id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    assert rows(audit_filters(jobs, labels), *COLUMNS) == sorted(plain_audit(made, marks), key=repr)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "id long, quality int, toxic int")
    assert audit_filters(postings(spark), labels).count() == 0
    assert text_counts(postings(spark)).count() == 0
    assert audit_filters(postings(spark, (1, "x")), labels).count() == 600
