import dataclasses
import math
import random
import re
import zlib

import numpy as np
import pytest
from jobstrata.llm import boost
from jobstrata.llm.language_id import TEMPERATURES, cut_out, features, fit_language, fit_temperature, has_letter, identify, train_ftrl
from jobstrata.llm.personal_data import KINDS, candidates, find_personal_data, luhn, redact, rewrite, rewritten, rule_spans
from jobstrata.llm.quality_classifier import STATISTICS, fit_rules, keep_good, held_out, lasso_logistic, score_quality, statistics
from pyspark.sql import functions as F

from tests.llm.helpers import documents, postings, rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("doc_id", "id")


@pytest.fixture(scope="module")
def corpus(spark):
    return postings(spark, *documents("sf0.01"))


def test_trees_fit_and_give_paths():
    x = np.random.default_rng(0).random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    start, trees = boost.fit(x, y, trees=10)
    assert ((boost.log_odds(start, trees, x) > 0) == y).mean() > 0.98
    path = trees[0].paths()[0]
    assert all(len(t) == 3 for t in path)
    assert boost.fit(np.zeros((4, 2)), np.ones(4))[1][0].feature.tolist() == [-1]


def test_lasso_drops_rules_that_say_nothing():
    rng = np.random.default_rng(1)
    r = (rng.random((800, 20)) > 0.5).astype(float)
    y = (r[:, 3] > 0).astype(float)
    _, w = lasso_logistic(r, y, 0.01)
    assert w[3] > 1 and (np.delete(w, 3) == 0).all()


def test_rules_compile_to_the_same_scores(spark, corpus):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(STATISTICS)))
    model = fit_rules(x, (x[:, 2] + x[:, 5] > 1).astype(float))
    assert model.rules
    df = spark.createDataFrame([[float(v) for v in row] for row in x[:50]], [f"{s}" for s in STATISTICS])
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.predict(x[:50]))
    assert fit_rules(np.zeros((0, len(STATISTICS))), np.zeros(0)).intercept == 0.0


def test_quality_of_held_out_postings(corpus, labelled):
    found = score_quality(corpus, labelled)
    fold = {r.id: r.held_out for r in found.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in fold.items())
    held = found.join(labelled, "id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count() > 0
    # labels of the held-out fold aren't read
    flipped = labelled.withColumn("quality", F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(score_quality(corpus, flipped), "id", "score") == rows(found, "id", "score")


def test_quality_of_odd_rows(spark, labelled):
    jobs = postings(spark, (1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 50000), (None, "b"))
    got = score_quality(jobs, labelled.limit(0)).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert score_quality(postings(spark), labelled).count() == 0
    kept = keep_good(jobs, labelled.limit(0))
    assert kept.columns == jobs.columns and kept.count() == 6
    assert statistics(jobs).filter("id = 4 and same_as_last = 1.0").count() == 1


def test_languages_of_held_out_postings(corpus):
    found = identify(corpus).join(corpus.select("id", "language"), "id").filter("held_out")
    assert found.filter("language_pred = language").count() >= 0.97 * found.count() > 0
    assert found.filter("score < 0 or score > 1").count() == 0


def test_scores_of_short_texts_are_calibrated(corpus):
    """On cut-outs of held-out postings the fitted temperature loses less than none, and lies within its bounds."""
    model = fit_language(corpus)
    assert TEMPERATURES[0] * 1.05 < model.temperature < TEMPERATURES[1] * 0.95
    held = corpus.filter(held_out(F.col("id")) & F.col("language").isNotNull() & (F.length("description_raw") > 60)).select("id", "language", "description_raw").collect()
    loss = {}
    for t in (model.temperature, 1.0, 0.02):
        tried = dataclasses.replace(model, temperature=t)
        p = [(tried.predict(piece), r.language) for r in held for n in range(4) for piece in [cut_out(r.description_raw, n)] if has_letter(piece)]
        loss[t] = -np.mean([np.log(max(1e-12, s if name == right else (1 - s) / (len(model.languages) - 1))) for (name, s), right in p])
    assert loss[model.temperature] <= min(loss.values()) + 1e-9, loss


def test_predictions_equal_plain_ones(corpus):
    """The scoring again, from the fitted weights and a dictionary of n-grams per text."""
    model = fit_language(corpus)
    for r in corpus.limit(40).collect():
        bins, tf = features(r.description_raw or "")
        logits = list(model.bias)
        norm = sum((t * model.idf[b]) ** 2 for b, t in zip(bins, tf)) ** 0.5
        for b, t in zip(bins, tf):
            for c in range(len(logits)):
                logits[c] += t * model.idf[b] / norm * model.weights[b, c]
        if has_letter(r.description_raw or ""):
            e = [math.exp((z - max(logits)) / model.temperature) for z in logits]
            name, score = model.predict(r.description_raw)
            assert name == model.languages[int(np.argmax(logits))] and score == pytest.approx(max(e) / sum(e))


def test_languages_of_odd_rows(spark):
    jobs = postings(
        spark, *[(k, f"the cat and the dog {k}", "en") for k in range(40)], *[(100 + k, f"der Hund und die Katze {k}", "de") for k in range(40)],
        (200, None, "en"), (201, "", "en"), (202, "123 !", "de"), (203, "é", None), (204, "der und " * 40000, "de"), (204, "der und", "de"),
    )
    got = {r.id: (r.language_pred, r.score) for r in identify(jobs).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[203][0] in ("de", "en") and got[204][0] == "de" and got[3][0] == "en"
    assert identify(jobs).count() == 86
    assert {r.language_pred for r in identify(postings(spark, (1, "a b"))).collect()} == {"und"}
    assert identify(postings(spark)).count() == 0


def test_features_cover_the_whole_text(monkeypatch):
    text = "abcdé" * 400
    whole = features(text)
    monkeypatch.setattr("jobstrata.llm.language_id._CHUNK", 64)
    pieces = features(text)
    assert (whole[0] == pieces[0]).all() and np.allclose(whole[1], pieces[1])
    assert has_letter("1é") and not has_letter("12 _!")


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    data = [(np.array([k % 2, 10 + rng.integers(500)]), np.array([0.8, 0.6]), k % 2) for k in range(200)]
    few, _ = train_ftrl(data, 2, l1=0.5)
    many, _ = train_ftrl(data, 2, l1=0.0)
    assert 0 < (few != 0).sum() < (many != 0).sum()
    logits = rng.normal(size=(2000, 3))
    labels = np.array([rng.choice(3, p=np.exp(z) / np.exp(z).sum()) for z in logits])
    assert 2.4 < fit_temperature(3 * logits, labels) < 3.7


RULES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits or "1"), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c x@y a.b+c@d-e.f.g@h.i @x.y a@@b.c a@b..c %@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 99999999999.1.1.1 .1.2.3.4.", "4111 1111-1111 1111 41111111111111111 4111  1111",
    "+1 (269) 555-3296 4524132264652876 +12 345 678 90. +1+2345678901 +(1)", "é" * 5 + "joe@é.com joe@e.com", "0" * 3000, "1 " * 3000, "@" * 2000, "a" * 3000 + "@b", "",
]


def test_rules_agree_with_plain_patterns():
    for text in [*TRICKY, *[t for _, t, *_ in documents("sf0.01") if re.search("[0-9@]", t or "")]]:
        assert rule_spans(text)[0] == plain_spans(text), text[:80]
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_candidates_grow_with_the_text_only():
    assert len(candidates("12 " * 5000)) <= 40 * 5000
    assert ("phone", "+1 (269) 555-3296") in {(KINDS[k], "call +1 (269) 555-3296 4524132264652876"[a:b]) for a, k, b in candidates("call +1 (269) 555-3296 4524132264652876")}


def test_the_method_adds_spans_and_keeps_rule_spans(spark):
    made = [(k, f"mail joe{k}@mail.example.com or +1 (269) 555-{3000 + k} from 10.0.{k % 250}.7 card 4111 1111 1111 1111, order {k}.{k}.{k} and {10**12 + k}") for k in range(400)]
    made += [(900, "call +1 (269) 555-3296 4524132264652876 now"), (901, None), (902, ""), (903, "no data here, version 2.0"), (903, "no data here, version 2.0")]
    got = {r.id: ([(s.kind, s.start, s.end) for s in r.rule_spans], [(s.kind, s.start, s.end) for s in r.spans]) for r in find_personal_data(postings(spark, *made)).collect()}
    assert all(set(a) <= set(b) for a, b in got.values())
    assert got[900][0] == [] and ("phone", 5, 22) in got[900][1]
    assert got[901] == got[902] == got[903] == ([], [])
    assert find_personal_data(postings(spark)).count() == 0
    assert [len(r.spans) for r in find_personal_data(postings(spark, (1, "joe@mail.example.com"))).collect()] == [1]


def test_rewritten_spans_are_candidates():
    text = "joe.b@mail.example.com, 10.0.12.7; +1 (269) 555-3296 or 4111 1111 1111 1111."
    good = rule_spans(text)[0]
    for n in range(60):
        for start, kind, end in good:
            own = f"see {rewrite(kind, text[start:end], n)} now"
            assert (4, kind, len(own) - 4) in candidates(own), own
    new, spans = rewritten(text, good)
    assert [k for _, k, _ in spans] == [k for _, k, _ in good] and all(s in candidates(new) for s in spans)
    assert not set(text[a:b] for a, _, b in good) & set(new[a:b] for a, _, b in spans)


def test_other_formats_are_found(spark):
    """A corpus in plain formats only, with dates, orders and other numbers; planted spans in formats that no rule reads."""
    draw = random.Random(4)

    def phone():
        return f"{draw.randint(200, 999)}", f"{draw.randint(200, 999)}", f"{draw.randint(0, 9999):04}"

    def card():
        head = "4" + "".join(str(draw.randint(0, 9)) for _ in range(14))
        return next(head + str(c) for c in range(10) if luhn(head + str(c)))

    noise = [
        lambda: f"Posted on {draw.randint(1990, 2024)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02} 10:{draw.randint(10, 59)}:00.", lambda: f"Order {draw.randint(10**9, 10**10)} of batch {draw.randint(10, 99)}.",
        lambda: f"Version {draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(300, 900)}.{draw.randint(0, 9)} shipped.", lambda: f"Between {draw.randint(1, 9)},{draw.randint(100, 999)},{draw.randint(100, 999)} and {draw.randint(10, 99)},{draw.randint(100, 999)},{draw.randint(100, 999)} users.",
        lambda: f"Meet at noon . then {draw.randint(2, 9)} teams dot the map.", lambda: f"Part no {draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}.",
    ]
    plain = [
        lambda: f"Mail {draw.choice(['joe', 'ann', 'li'])}{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.com today.", lambda: "Call +1 ({}) {}-{} now.".format(*phone()), lambda: "Phone +1 {} {} {} please.".format(*phone()),
        lambda: "Card {} on file.".format(" ".join(c[k:k + 4] for c in [card()] for k in range(0, 16, 4))), lambda: f"Host 10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.{draw.randint(1, 254)} answers.",
    ]
    made = [(k, " ".join(draw.choice(noise)() for _ in range(3)) + " " + draw.choice(plain)() + " " + draw.choice(noise)()) for k in range(2000)]
    planted = [
        (3, lambda: "{}-{}-{}".format(*phone())), (3, lambda: "({}) {}-{}".format(*phone())), (3, lambda: "{} {} {}".format(*phone())), (3, lambda: "{}.{}.{}".format(*phone())),
        (2, lambda: ".".join(c[k:k + 4] for c in [card()] for k in range(0, 16, 4))), (2, lambda: "/".join(c[k:k + 4] for c in [card()] for k in range(0, 16, 4))),
        (0, lambda: f"joe{draw.randint(1, 99)} [at] example [dot] org"), (0, lambda: f"ann{draw.randint(1, 99)} at mail.example.com"), (1, lambda: f"10[.]{draw.randint(0, 255)}[.]{draw.randint(0, 255)}[.]7"),
    ]
    lead = ("Mail ", "Host ", "Card ", "Call ")
    want = {}
    for k in range(900):
        kind, form = planted[k % len(planted)]
        own, before = form(), " ".join(draw.choice(noise)() for _ in range(2)) + " " + lead[kind]
        want[10_000 + k] = (KINDS[kind], len(before), len(before) + len(own))
        made.append((10_000 + k, before + own + " please. " + draw.choice(noise)()))
    hit = added = right = 0
    for r in find_personal_data(postings(spark, *made)).collect():
        rules = {(s.kind, s.start, s.end) for s in r.rule_spans}
        more = {(s.kind, s.start, s.end) for s in r.spans} - rules
        added, right = added + len(more), right + (want.get(r.id) in more)
        hit += want.get(r.id) in more | rules
    assert hit >= 0.9 * len(want), hit / len(want)
    assert right >= 0.9 * added, (right, added)


def test_redaction():
    assert redact("a joe@x.y b", [(2, 0, 9)]) == "a [email] b" and redact("12345", [(0, 1, 3), (2, 2, 5)]) == "[ip]"
