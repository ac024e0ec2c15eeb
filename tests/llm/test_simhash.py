import random
from collections import Counter

import pytest
import xxhash

from labelloom.llm import simhash
from labelloom.llm.components import components


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_is_the_majority_of_bits(rows):
    for row in rows:
        assert simhash.fingerprint(row[1]) == signed(brute_print(row[1]))


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("limit", [2, 64])
def test_links_connect_what_is_near(spark, bits, limit):
    rng = random.Random(bits)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(signed(x))
        for _ in range(15):
            x ^= 1 << rng.randrange(64)
            prints.add(signed(x))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {(r.a, r.b) for r in simhash.links(df, bits, limit).collect()}

    def differ(a, b):
        return ((a ^ b) & ((1 << 64) - 1)).bit_count()

    near = [(a, b) for a in prints for b in prints if a < b and differ(a, b) <= bits]
    assert all(differ(a, b) <= bits for a, b in found)
    assert closure(prints, found) == closure(prints, near)


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}


def test_near_duplicates_against_brute_force(docs, rows):
    prints = [brute_print(r[1]) for r in rows]
    linked = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2]
    root = closure(set(prints), linked)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    want = Counter((r[0], signed(p), least.get(root[p])) for r, p in zip(rows, prints, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    groups = {root[p] for p in prints}
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).count() == 0
