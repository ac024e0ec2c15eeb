"""Target-distribution resampling against a plain count of every feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from labelloom.llm import target_sampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(x.encode()) % buckets for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(cells, target, buckets=10_000, share=25, least=20):
    every = Counter(b for _, t in cells for b in features(t, buckets))
    goal = Counter(b for t in target for b in features(t, buckets))
    n, m = sum(every.values()), sum(goal.values())
    gain = [
        math.floor(1000 * math.log((goal[b] + 1) * (n + buckets) / ((every[b] + 1) * (m + buckets)))) for b in range(buckets)
    ]
    out = []
    for i, text in cells:
        own = features(text, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [r for r in out if (r[1] + 1) // 2 >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        ranks[(*r, rank)] += 1
    drawn = Counter(r[:4] for r in ranks.elements())
    return ranks + Counter((*r, None) for r in (Counter(out) - drawn).elements())


EXTRA = [
    "one line\nof two\n\n  \nwords ONE Line", "\n\n", "a-b\nc_d é\nÉ x9", "word\n" * 40, "tail\n" * 3 + "ends here " * 30,
    "Same hot line of many words here\n" * 25, "漢字 かな\n漢字 かな",
]


@pytest.mark.parametrize(("buckets", "share", "least"), [(10_000, 25, 20), (7, 60, 1)])
def test_sample_against_brute_force(spark, docs, rows, buckets, share, least):
    extra = [(500 + i, t) for i, t in enumerate(EXTRA * 3)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    df = docs.select("doc_id", "text", "size", "row").unionByName(more, allowMissingColumns=True)
    goals = [rows[0][1], "hot line of words", None, "", "two\nlines w1 w2"]
    target = spark.createDataFrame([(i, g) for i, g in enumerate(goals)], "item_id long, text string")
    cells = [(r[0], r[1]) for r in rows] + extra
    found = target_sampling.sample(df, target, buckets, share, least).collect()
    assert Counter(map(tuple, found)) == brute(cells, goals, buckets, share, least)


def test_empty_sides(spark, docs, rows, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert target_sampling.sample(empty, nothing).count() == 0
    found = target_sampling.sample(docs, nothing).collect()
    assert Counter(map(tuple, found)) == brute([(r[0], r[1]) for r in rows], [])


def test_lines_and_ends():
    lines = target_sampling.lines_of("Aa b-C\n--\n\nd")
    assert lines == [b"aa b-c", b"d"]
    assert target_sampling.across(lines) == [zlib.crc32(b"c d") % 10_000]
    bucket, owner = target_sampling.line_features(lines)
    assert owner.tolist() == [0] * 5 + [1]
    assert sorted(bucket[:5].tolist()) == sorted(features("aa b c", 10_000))


def test_the_sample_leans_to_the_target(spark):
    cells = [(i, ("physics of stars and light " if i % 2 else "buy cheap watches now online ") * 8) for i in range(400)]
    df = spark.createDataFrame(cells, "doc_id long, text string")
    target = spark.createDataFrame([(1, "the physics of light from distant stars")], "item_id long, text string")
    drawn = [r.doc_id for r in target_sampling.drawn(df, target).collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 60
