import zlib

import numpy as np
import pytest
from jobstrata.llm import rans
from jobstrata.llm.common import shared_folder
from jobstrata.llm.pieces import Pieces
from jobstrata.llm.token_files import default_vocabulary, encode_postings, read_token_files, write_token_files

from tests.llm.helpers import documents, postings, rows

ODD = [
    None, "", " ", " a  b\n c \n\n  d's 'x <|endoftext|> x<|endoftext|>", "\0 a b", "a\t b  c  d      é x × y ÷ z 　 q", "x\r\n  y   z",
    "don't  can't 'll é'll l'été", "!!! 0 !", "word " * 30000, " ".join(f"w{k}" for k in range(9000)),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    texts = [t or "" for t in ODD] + [t for _, t, *_ in documents("sf0.001")]
    pieces = Pieces(default_vocabulary())
    for _ in range(2):  # once with everything new, once with everything known
        ids, counts = pieces.encode(texts)
        assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70001])
def test_images_round_trip(n):
    tokens = (np.random.default_rng(n).zipf(1.3, n) % 50000).astype(np.uint32)
    data = rans.encode(tokens, [n], block_tokens=30000)
    image = rans.Image(data)
    assert (image.tokens() == tokens).all() and image.counts.tolist() == [n]
    if n > 1000:
        with pytest.raises(ValueError):
            broken = bytearray(data)
            broken[-1] ^= 1
            rans.Image(bytes(broken)).tokens()
        with pytest.raises(ValueError):
            rans.Image(data[:-4])


def test_decoding_starts_at_any_checkpoint():
    tokens = (np.random.default_rng(3).zipf(1.2, 1_500_000) % 50000).astype(np.uint32)
    image = rans.Image(rans.encode(tokens, [len(tokens)]))
    for k, (n, *_) in enumerate(image.entries):
        whole = image.block(k)
        for point in range(image.entries[k][3]):
            part = image.block(k, point)
            assert (whole[n - len(part):] == part).all()
    assert image.entries[0][3] > 1 and len(image.data) < 2 * len(tokens)


def test_one_symbol_and_frequencies():
    symbols, freqs = rans.table_of(np.full(5, 7, np.uint32))
    assert symbols.tolist() == [7] and freqs.tolist() == [1 << rans.BITS]
    _, freqs = rans.table_of(np.arange(50000, dtype=np.uint32))
    assert freqs.sum() == 1 << rans.BITS and freqs.min() >= 1


def test_files_hold_every_posting(spark, tokenizer):
    made = [*enumerate(ODD), *[(100 + k, t) for k, t, *_ in documents("sf0.001")], (3, "same id"), (3, "same id")]
    jobs = postings(spark, *made)
    folder = shared_folder(spark, "test-tokens")
    write_token_files(jobs, folder)
    start, want = 0, []
    for k, t in sorted(made, key=lambda r: (r[0], (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows(read_token_files(spark, folder), "id", "start", "n_tokens", "ids_crc32")) == sorted(want)


def test_small_files_and_empty_tables(spark):
    jobs = postings(spark, *[(k, f"text number {k}") for k in range(50)])
    assert encode_postings(jobs, file_tokens=20).count() > 5
    folder = shared_folder(spark, "test-tokens")
    write_token_files(postings(spark), folder)
    assert read_token_files(spark, folder).count() == 0
