import random

import pytest
import xxhash
from pyspark.sql import functions as F

from jobstrata.llm import fingerprints as fpr
from jobstrata.llm.fingerprints import fingerprint, links, postings_of_tables, simhash_groups

from tests.llm.helpers import documents, postings, rows


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(made):
    """Smallest id reachable of every (id, fingerprint), all pairs compared."""
    root = list(range(len(made)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(made)):
        for b in range(a):
            if (made[a][1] ^ made[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (id_, _) in enumerate(made):
        least[find(k)] = min(id_, least.get(find(k), id_))
    return [(id_, least[find(k)]) for k, (id_, _) in enumerate(made)]


ODD = [None, "", " \t\n", "one", "One\x0btwo", "A b C", "a b c d", "É é Ünï x　y z", "word " * 9000, "x" * 300_000, "a b c d e f g h"]


def test_fingerprints_equal_plain_ones(spark):
    texts = ODD + [t for _, t, *_ in documents("sf0.001")]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    # The engine's own hash of a string is the same one.
    one = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert one % 2**64 == xxhash.xxh64(b"a b c d", seed=42).intdigest() == fingerprint("A  b c\nd")


def test_groups_of_the_documents_equal_brute_force(spark):
    made = [(k, t) for k, t, *_ in documents("sf0.01")]
    want = plain_groups([(k, fingerprint(t)) for k, t in made])
    assert rows(simhash_groups(postings(spark, *made)), "id", "component_id") == sorted(want, key=repr)
    assert len({c for _, c in want}) < len(made)


def _clouds(seed, centres, each, flips):
    draw, found = random.Random(seed), set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            value = centre
            for b in draw.sample(range(64), draw.randint(0, flips)):
                value ^= 1 << b
            found.add(value)
    return sorted(found)


def _signed(v):
    return v - 2**64 if v >> 63 else v


@pytest.mark.parametrize("bucket", [fpr.BUCKET, 12])
def test_links_join_what_all_pairs_join(spark, bucket):
    """Clouds that chain, lone values, and buckets both whole and cut into cells."""
    values = _clouds(5, 4, 60, 7) + _clouds(6, 60, 2, 5) + [0, 1, 3, 2**64 - 1, 2**63]
    prints = spark.createDataFrame([(_signed(v),) for v in sorted(set(values))], "fp long")
    place = {v: k for k, v in enumerate(sorted(set(values)))}
    want = dict(plain_groups([(k, v) for v, k in place.items()]))
    root = list(range(len(place)))
    for a, b in links(prints, bucket).collect():
        a, b = place[a % 2**64], place[b % 2**64]
        assert want[a] == want[b]  # never two groups joined
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for k in range(len(root)):
        r = k
        while root[r] != r:
            r = root[r]
        assert want[k] == want[r]
        assert r == want[k]


def test_each_near_pair_meets_in_a_bucket(spark):
    draw = random.Random(1)
    for _ in range(20):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 4):
            b ^= 1 << bit
        table = postings_of_tables(spark.createDataFrame([(_signed(a),), (_signed(b),)], "fp long")).collect()
        by = {}
        for r in table:
            by.setdefault((r["segment"], r["key"]), []).append((r["fp"], r["entry"]))
        assert any(len({f for f, _ in met}) == 2 and any(e for _, e in met) for met in by.values())


def test_odd_rows(spark):
    text = "we are looking for someone to run our data platform in Berlin"
    made = [(1, text), (1, text), (2, None), (3, ""), (4, " "), (None, text), (5, text.upper()), (6, "another text that shares nothing at all"), (6, None)]
    found = rows(simhash_groups(postings(spark, *made)), "id", "component_id")
    assert found == sorted([(1, 1), (1, 1), (2, 2), (3, 2), (4, 2), (None, None), (5, 1), (6, 6), (6, 2)], key=repr)
    zero = {r["fingerprint"] for r in simhash_groups(postings(spark, *made)).filter("id in (2, 3, 4)").collect()}
    assert zero == {"0" * 16}
    assert simhash_groups(postings(spark)).count() == 0


def test_ids_of_other_types(spark):
    jobs = spark.createDataFrame([("acme:2", "a b c d e"), ("acme:1", "a b c d e"), ("beta:1", "something else here now")], "id string, description_raw string")
    assert rows(simhash_groups(jobs), "id", "component_id") == [("acme:1", "acme:1"), ("acme:2", "acme:1"), ("beta:1", "beta:1")]
