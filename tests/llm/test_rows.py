"""Mixing, importance resampling, line dedup, substring dedup, vector search, pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from labelloom.llm import importance, lines, mixing, queries, suffix_dedup, va_file
from labelloom.llm.common import row_key
from tests.llm.conftest import words

FOLDER = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode().split())


def test_targets_by_hand(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 50), (None, 5), ("d", 0)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(sized).collect()}
    # weights 3, 1, 2, 3, 1 over a, b, c, d, null; all but b stop at twice their size
    assert found == {"a": 20.0, "c": 100.0, "d": 0.0, None: 10.0, "b": 1.5 * 1065 - 130}


def test_mix_takes_the_budget(docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in found:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in found:
        assert taken[r.source] == int(r.target)
    assert abs(sum({r.source: r.target for r in found}.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)


def test_mixed_documents_hold_the_words(docs):
    decided, mixed = mixing.mix(docs), mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "epoch"]
    want, got = Counter(), Counter()
    for r in decided.collect():
        want[r.doc_id] += r.taken
    for r in mixed.collect():
        got[r.doc_id] += size(r.text)
    repeated = {2, 40, None}  # repeated rows share one decision, so a border among them may move
    assert {k: v for k, v in want.items() if v and k not in repeated} == {
        k: v for k, v in got.items() if v and k not in repeated
    }


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 40 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 250, 260, 542):
        assert importance.kth_largest(df, "v", k, 7) == ordered[k - 1]


def test_resampling_tells_junk_from_prose(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        own = [f"junk{rng.randrange(60)}" if bad else f"w{rng.randrange(60)}" for _ in range(60)]
        rows.append((i, " ".join(own), "x"))
        if i % 3 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(None, "w1 w2", None), (700, None, None), (701, "", None), rows[1]]
    labels += [(None, 0), (3, None), (9999, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = importance.resample(df, marks, buckets=1 << 12).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3]
    wrong = sum(r.kept == (r.doc_id % 5 == 0) for r in held)
    assert wrong <= len(held) // 20
    kept = importance.keep_sampled(df, marks, buckets=1 << 12)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in found)
    assert importance.resample(df, marks.limit(0), buckets=64).where("NOT kept").count() == 0
    assert importance.resample(df.limit(0), marks, buckets=64).count() == 0


def brute_sample(rows, labels, buckets):
    """``log_weight`` and ``sample_key`` of every row, and the number of rows to keep."""
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def grams(text):
        one = [zlib.crc32(w) for w in (text or "").encode().lower().split()]
        two = [((x * a + y) * b % 2**64 >> 20) % buckets for x, y in zip(one, one[1:], strict=False)]
        return Counter([(x * a % 2**64 >> 20) % buckets for x in one] + two)

    judged = defaultdict(list)
    for i, quality in labels:
        if i is not None and quality is not None:
            judged[i].append(quality)
    good = {i for i, q in judged.items() if min(q) == 1}
    every, fine = Counter(), Counter()
    for i, text in rows:
        every.update(grams(text))
        fine.update(grams(text) if i in good else {})
    share = sum(fine.values()) / max(1, sum(every.values()))
    out = []
    for i, text in rows:
        weight = 0.0
        for g, n in grams(text).items():
            own = n if i in good else 0
            weight += n * math.log((fine[g] - own + 5) / ((every[g] - n) * share + 5))
        name = str(i) if i is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
        draw = (int(hashlib.md5(f"gumbel:{name}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        out.append((i, text, weight, weight - math.log(-math.log(draw))))
    return out, round(len(good) / len(judged) * len(rows))


@pytest.mark.parametrize("buckets", [1 << 18, 97])
def test_resampling_against_brute_force(spark, docs, rows, buckets):
    labels = [(i, int(i % 4 > 0)) for i in range(0, 40, 2)] + [(2, 1), (4, 0), (None, 1), (6, None), (999, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    want, k = brute_sample([(r[0], r[1]) for r in rows], labels, buckets)
    border = sorted((x[3] for x in want), reverse=True)[k - 1]
    found = importance.resample(docs, marks, buckets=buckets).collect()

    def order(r):
        return (r[0] is None, r[0] or 0, r[1])

    got = sorted(((r.doc_id, r.log_weight, r.sample_key, r.kept) for r in found), key=order)
    ours = sorted(((i, w, key, key >= border) for i, _, w, key in want), key=order)
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in ours]
    assert np.allclose([r[1:3] for r in got], [r[1:3] for r in ours], rtol=1e-9, atol=1e-6)


def test_log_weight_leaves_the_text_out():
    at, n = importance.ngram_counts("a b a", 64)
    every, good = np.zeros(64, np.int64), np.zeros(64, np.int64)
    every[at] += n
    good[at] += n
    assert importance.log_weight("a b a", True, every, good, 0.5) == 0
    assert importance.log_weight(None, False, every, good, 0.5) == 0


def brute_groups(found):
    sets = {h: {s[i : i + lines.SHINGLE] for i in range(max(1, len(s) - lines.SHINGLE + 1))} for h, s in found.items()}
    root = {h: h for h in found}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    for a in found:
        for b in found:
            if a < b and len(sets[a] & sets[b]) >= lines.SIMILARITY * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {h: find(h) for h in found}


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, 30) for _ in range(12)]
    texts = []
    for i in range(60):
        own = base[i % 12].split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(30)] = f"v{rng.randrange(99)}"
        texts.append("\n".join([" ".join(own), "", "  Same  LINE here ", words(rng, 12)]))
    texts += [None, "", "\n\n", "short", "x" * 9000, texts[0]]
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string").repartition(4)
    every = {lines.line_id(s): s for t in texts for _, s in lines._lines(t)}
    want = brute_groups(every)
    found = {r.h: r.root for r in lines.groups(df, lines.scan(df)).collect()}
    assert {h: found.get(h, h) for h in every} == want
    out = lines.dedup(df)
    assert out.columns == df.columns and out.count() == len(rows)
    left = Counter(want[lines.line_id(s)] for r in out.dropDuplicates().collect() for _, s in lines._lines(r.text))
    assert left == Counter(set(want.values()))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0].split("\n")[0] == lines.normal(texts[0].split("\n")[0])  # the first stays
    assert kept[60] is None and kept[61] == "" and kept[62] == "\n\n"
    assert lines.report(df.limit(0)).count() == 0


def test_heads_of_different_tasks_are_compared(spark):
    rng = random.Random(3)
    lone = sorted((words(rng, 30) for _ in range(200)), key=lines.line_id)
    low, high = lines.line_id(lone[0]), lines.line_id(lone[-17])
    pairs = []
    while len(pairs) < 8:
        one = words(rng, 30)
        if all(low < lines.line_id(x) < high for x in (one, one + " v1")):
            pairs.append((one, one + " v1"))
    # One band list over 17 parts, each with its head and a fellow: the smallest line leads one
    # part, both lines of each near pair lead a part of their own.
    heads = [lone[0], *(x for pair in pairs for x in pair)]
    parts = list(zip(map(lines.line_id, heads), map(lines.line_id, lone[-len(heads) :]), strict=True))
    assert all(a < b for a, b in parts) and min(parts)[0] == lines.line_id(lone[0])
    posts = [(1, a, b, 0, 0, 0) for a, fellow in parts for b in (a, fellow)]
    scanned = spark.createDataFrame(posts, "k long, a long, b long, _lm_id long, _lm_text long, line int")
    texts = [*heads, *lone[-len(heads) :]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.h: r.root for r in lines.groups(df, scanned).collect()}
    want = brute_groups({lines.line_id(t): t for t in texts})
    assert len(set(want.values())) == len(texts) - len(pairs)
    assert {h: found.get(h, h) for h in want} == want


def test_lines_alone_make_no_rows_and_parts_agree(spark, monkeypatch):
    rng = random.Random(11)
    lone = [words(rng, 20, 9000) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lone)], "doc_id long, text string").repartition(6)
    assert lines.scan(df).count() == 0

    base = [words(rng, 30) for _ in range(6)]
    texts = []
    for i in range(80):
        own = base[i % 6].split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(30)] = f"v{rng.randrange(9)}"
        texts.append("\n".join([lone[i], " ".join(own), "Common line", "", "common  LINE", lone[rng.randrange(300)], "ab", "ab\0"]))
    rows = [(None if i % 9 == 4 else i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[4], (3, texts[5]), (None, None)]
    monkeypatch.setattr(lines, "_PART", 50)  # many parts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_groups({lines.line_id(s): s for t in texts for _, s in lines._lines(t)})
    digests = {(r.doc_id, r.text): r._lm_text for r in df.select("*", *row_key()).collect()}
    places = defaultdict(set)
    for own, text in rows:
        for i, s in lines._lines(text):
            key = lines.NO_ID if own is None else own
            places[want[lines.line_id(s)]].add((own is None, key, digests[own, text], i))
    gone = {p[1:] for group in places.values() for p in sorted(group)[1:]}
    assert {tuple(r) for r in lines.removals(df).collect()} == gone


def test_hashed_shingles_against_strings():
    rng = random.Random(4)
    some = [words(rng, rng.randrange(1, 40), 30) for _ in range(60)] + ["a", "a\0", "\u6f22\u5b57 " * 9 + "x", "ab" * 50, "b" * 9]
    for part in (some, some[:1], []):
        h, owner = lines.shingle_hashes(part)
        want = []
        for i, s in enumerate(part):
            codes = [ord(c) for c in s.ljust(lines.SHINGLE, "\0")]
            for at in range(len(codes) - lines.SHINGLE + 1):
                x = 0
                for c in codes[at : at + lines.SHINGLE]:
                    x = (x * 0x100000001B3 + c) % (1 << 64)
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
                x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
                want.append((x ^ x >> 31, i))
        assert list(zip(h.tolist(), owner.tolist(), strict=True)) == want
    near = [(s, s + "v") for s in some] + [(s, t) for s in some for t in some]
    exact = [lines.jaccard(lines.shingles(s), lines.shingles(t)) >= lines.SIMILARITY for s, t in near]
    assert lines.alike(*map(list, zip(*near, strict=True)), lines.SIMILARITY) == exact
    assert 60 < sum(exact) < len(exact) / 2


def test_bands_meet_for_near_lines():
    rng = random.Random(2)
    met = total = 0
    for _ in range(300):
        a = words(rng, 25)
        b = a[: len(a) // 2] + "zq" + a[len(a) // 2 :]
        if lines.jaccard(lines.shingles(a), lines.shingles(b)) >= lines.SIMILARITY:
            keys = lines.band_keys([a, b])
            met += bool((keys[0] == keys[1]).any())
            total += 1
    assert total > 200 and met >= 0.99 * total


def brute_cover(texts, length):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places[t[i : i + length]].append((d, i))
    cover = [np.zeros(len(t) + 1, bool) for t in texts]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i : i + length] = True
    return cover


@pytest.mark.parametrize("options", [{}, {"bits": 64}, {"pieces": 1}])
def test_substrings_against_brute_force(docs, rows, options):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, c in zip(rows, texts, brute_cover(texts, 200), strict=True):
        kept = bytes(b for b, gone in zip(t, c, strict=False) if not gone)
        spans = int((np.diff(c.astype(int), prepend=0) == 1).sum())
        want[(r[0], len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.report(docs, **options).collect())) == want


def test_copies_of_grams_that_pass_the_hot_filter_by_chance(spark):
    rng = random.Random(12)

    def draw(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    # Passages amid other words have many different pieces, exact short texts one each.
    passages = [draw(260) for _ in range(12)]
    texts = [draw(150) + p + draw(150) for p in passages for _ in range(3)]
    texts += [t for t in (draw(210) for _ in range(60)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {d: int(c.sum()) for d, c in enumerate(brute_cover([t.encode() for t in texts], 200))}
    assert min(want.values()) >= 210
    found = suffix_dedup.report(df, pieces=1, hot_bits=64)
    assert {r.doc_id: r.n_removed for r in found.collect()} == want


def test_no_text_no_substrings(empty):
    assert suffix_dedup.report(empty).count() == 0


def test_extensions_cover_small_cases():
    rng = random.Random(6)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abcdefgh"])

        def draw(n, letters=letters):
            return bytes(rng.choice(letters) for _ in range(n))

        shared = [draw(rng.randint(10, 80)) for _ in range(3)] + [draw(3) * 25]
        texts = [
            b"".join(rng.choice([draw(rng.randint(0, 40)), *shared]) for _ in range(rng.randint(0, 5)))
            for _ in range(8)
        ]
        length, gram = 24, 8
        for limit in (10**9, 1):
            found = [suffix_dedup._Text(t.decode(), length, gram) for t in texts]
            marked = Counter(g for t in found for g in t.g.tolist())
            groups, where = defaultdict(list), []
            for d, t in enumerate(found):
                hot = np.array([marked[g] > limit for g in t.g.tolist()], bool)
                for k, h, low, high, off in zip(*(x.tolist() for x in suffix_dedup._units(t, hot, length)), strict=True):
                    groups[k].append((k, h, 1, off, texts[d][low:high] if off >= 0 else None))
                    where.append((k, h, d, low))
            spans = {(k, h): s for rows in groups.values() for k, h, s in suffix_dedup.covers(rows, length)}
            cover = [np.zeros(len(t) + 1, bool) for t in texts]
            for k, h, d, low in where:
                for a, b in spans.get((k, h), ()):
                    cover[d][low + a : low + b] = True
            assert all((x == y).all() for x, y in zip(cover, brute_cover(texts, length), strict=True))


def test_intervals_of_common_prefixes():
    rows = sorted([b"abc", b"abd", b"abd", b"b", b"ba", b"c"])
    found = set(suffix_dedup.intervals(rows))
    assert {(2, 0, 3), (3, 1, 3), (1, 3, 5)} <= found
    assert all(min(suffix_dedup.shared(a, b) for a, b in zip(rows[x:y], rows[x + 1 : y], strict=False)) == d
               for d, x, y in found)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in (301, 302, 320)]  # ties
    rows += [(40, rng.normal(0, 0.2, 8).tolist()), (None, rows[3][1])]
    rows += [(400, None), (420, [0.1, None] * 4), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, [])]
    rows += [(500, [1e18] * 8), (501, [-1e18] * 8), (520, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = [(k, v) for k, v in rows if v and None not in v and np.isfinite(v).all()]
    ints = [[int(np.floor(64 * x)) for x in v] for _, v in good]
    want = Counter()
    for q, (key, v) in enumerate(good):
        if key is None or key % 20:
            continue
        scores = []
        for c, (other, w) in enumerate(good):
            if c != q and len(w) == len(v):
                s = sum(a * b for a, b in zip(ints[q], ints[c], strict=True))
                scores.append((-min(max(s, -(1 << 63)), (1 << 63) - 1), other is None, other))
        for rank, (s, _, other) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:20], 1):
            want[(key, rank, other, -s)] += 1
    for block in (16, 4096):
        assert Counter(map(tuple, va_file.top_k(df, block=block).collect())) == want
    assert va_file.top_k(df.limit(0)).count() == 0


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now = docs
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, FOLDER).cache()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert after.count() <= now.count()
        now = after
    want = Counter(map(tuple, now.collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want
    assert want


def test_stages_take_empty_tables(spark):
    now = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER)
    assert now.count() == 0


def test_all_are_registered():
    names = registered.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
