import random
from collections import Counter

import numpy as np
import pytest

from jobstrata.llm import sentence_pieces, token_alignment as ta
from jobstrata.llm.pieces import Pieces
from jobstrata.llm.sentence_pieces import SentencePieces
from jobstrata.llm.token_alignment import align_tokenizers, byte_of_character, default_vocabularies, lockstep, packed_tokens

from tests.llm.helpers import documents, postings, rows

PATH_A, PATH_B = default_vocabularies()
ODD = [
    None, "", " ", "  ", "\n", " a  b\n c \n\n  d's  ", "x <|endoftext|> y<|endoftext|>", "<s> </s> <unk> <0x41>", "a\0b \0", "▁ a▁b", "日本語 テキスト、です", "😀 😀😀",
    "don't l'été × y ÷ 　 q", "   leading", "trailing   ", "a" * 3000, "word " * 20000, "tab\tand\r\nlines\x0b\x0c", "﻿mark", "é combining", "ﬁ ligature Å",
]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATH_B)


def plain_tokens(models, text):
    """(ids, bytes of each) of A and of B, or empty lists."""
    a, b = models
    if not text:
        return [], []
    byte = byte_of_character()
    first = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(s for _, s in first) != want or b"".join(s for _, s in second) != want:
        return [], []
    return first, second


def plain_alignment(models, made):
    out, corpus = [], Counter()
    for id_, text in made:
        first, second = plain_tokens(models, text)
        ends = [dict(), dict()]
        for side, tokens in zip(ends, (first, second)):
            at = 0
            for k, (_, s) in enumerate(tokens):
                at += len(s)
                side[at] = k
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(first[ends[0][c]][0], second[ends[1][c]][0]) for c in cuts]
        corpus.update(links)
        groups, x, y = [], 0, 0
        for c in cuts:
            groups.append(",".join(str(i) for i, _ in first[x:ends[0][c] + 1]) + "|" + ",".join(str(i) for i, _ in second[y:ends[1][c] + 1]))
            x, y = ends[0][c] + 1, ends[1][c] + 1
        out.append((id_, len(first), len(second), len(cuts), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    return sorted(((i, a, b, c, len(l), sum(corpus[p] == most[p[1]] for p in l), sum(corpus[p] for p in l), g) for i, a, b, c, l, g in out), key=repr)


COLUMNS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_words_give_the_ids_of_whole_texts(models, monkeypatch):
    texts = [t or "" for t in ODD] + [t for _, t, *_ in documents("sf0.001")]
    pieces = SentencePieces(PATH_B)
    want = [models[1].encode(t) for t in texts]
    for _ in range(2):  # once with everything new, once with everything known
        ids, counts = pieces.encode(texts)
        assert ids.tolist() == [i for own in want for i in own] and counts.tolist() == [len(own) for own in want]
    monkeypatch.setattr(sentence_pieces, "MAX_KNOWN", 10)  # the store starts anew each time
    small = SentencePieces(PATH_B)
    assert [small.encode([t])[0].tolist() for t in texts[-30:]] == want[-30:]


def test_texts_may_begin_and_end_with_white_space(models):
    """In one batch: a text that ends with a blank and others that begin with blanks, line ends or signs."""
    texts = [" a ", "  b", " \n c", " 、d", "  ", " e  ", "   f g "] * 3
    ids, counts = Pieces(PATH_A).encode(texts)
    want = [models[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for own in want for i in own] and counts.tolist() == [len(own) for own in want]


@pytest.mark.parametrize("seed", range(5))
def test_lockstep_finds_common_ends_whatever_the_sections(seed):
    draw = random.Random(seed)
    stop = 2000
    a, b = (np.array(sorted({*draw.sample(range(1, stop), draw.randint(1, 900)), stop})) for _ in range(2))
    common = sorted(set(a.tolist()) & set(b.tolist()))
    for section in (1, 7, 512, 10_000):
        x, y = lockstep(a, b, np.array([*range(0, stop, section), stop]))
        assert a[x].tolist() == b[y].tolist() == common
    assert [len(v) for v in lockstep(a[:0], b[:0], np.array([0]))] == [0, 0]


def test_alignment_equals_a_plain_one(spark, models):
    made = [*enumerate(ODD), *[(100 + k, t) for k, t, *_ in documents("sf0.001")], (3, "same id"), (3, "same id"), (None, "no id")]
    assert rows(align_tokenizers(postings(spark, *made)), *COLUMNS) == plain_alignment(models, made)


def test_packed_tokens_hold_everything(spark, models):
    found = {r["id"]: r for r in packed_tokens(postings(spark, *enumerate(ODD))).collect()}
    for k, text in enumerate(ODD):
        for name, tokens in zip("ab", plain_tokens(models, text)):
            assert np.frombuffer(found[k][f"tokens_{name}"], "<u2").tolist() == [i for i, _ in tokens]
            last = np.unpackbits(np.frombuffer(found[k][f"cuts_{name}"], np.uint8), bitorder="little")
            assert len(last) == -(-len(tokens) // 8) * 8 and (not tokens or last[len(tokens) - 1] == 1)


def test_ties_and_empty_tables(spark, models):
    # Each B id of the text is linked once with one A id: every link is best, also where counts tie.
    made = [(1, "to"), (2, None), (3, "")]
    found = rows(align_tokenizers(postings(spark, *made)), *COLUMNS)
    assert found == plain_alignment(models, made) and found[0][5] == found[0][4] > 0 and found[1][1:] == (0,) * 6 + ("",)
    assert align_tokenizers(postings(spark)).count() == 0
    assert align_tokenizers(postings(spark, (1, None))).collect()[0]["groups"] == ""


def test_pairs_that_can_be_linked_are_bounded():
    pair = ta._pair(PATH_A, PATH_B)
    assert 50_000 < len(pair.pairs) < 1_000_000
    longest = [sum(map(len, s)) for s in (pair.spelled_a, pair.spelled_b)]
    assert len(pair.pairs) <= sum(longest) * 3  # a suffix of each length, spelled by few ids
