"""Token counts, decontamination, sanitisation and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelloom.llm import fm_index, lbl, sanitise, token_counts

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(docs, rows):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for r in rows:
        n = len(own.encode(r[1] or ""))
        want[(r[0], len((r[1] or "").encode()), n, n > 500)] += 1
    for table in (1, 1000):
        assert Counter(map(tuple, token_counts.token_counts(docs, MODEL, 500, table).collect())) == want


def test_pre_tokens_add_up():
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(1)
    signs = list(" \n\t\r;)▁ab<>é①0漢")
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(0, 25)))
        assert sum(token_counts.encode_lengths(own, token_counts.pre_tokens(text))) == len(own.encode(text))


def test_no_documents_no_counts(empty):
    assert token_counts.token_counts(empty, MODEL).count() == 0
    assert lbl.scores(empty).count() == 0
    assert sanitise.report(empty).count() == 0


# --- decontamination


def brute_hits(text, windows):
    words = fm_index.words_of(text)
    items, hit = set(), set()
    for n in {len(w.split(b" ")) for w in windows}:
        for i in range(len(words) - n + 1):
            key = b" ".join(words[i : i + n])
            if key in windows:
                items |= windows[key]
                hit |= set(range(i, i + n))
    return len(words), len(hit), items


@pytest.fixture(scope="module")
def bench(spark, rows):
    long = rows[0][1].split()
    items = [
        (1, " ".join(long[5:40])),
        (2, " ".join(long[20:33])),
        (3, "two, WORDS!"),
        (4, None),
        (5, ""),
        (6, "nowhere " * 20),
        (7, " ".join(long[20:33])),
        (None, rows[1][1]),
        (8, "ber " * 30),
    ]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = rng.integers(1, 4, rng.integers(1, 200))
        index = fm_index.FMIndex(text, sample=4)
        for n in (1, 2, 3, 5):
            phrase = rng.integers(1, 4, n)
            if not set(phrase) <= set(text):
                continue
            low, high = index.search(phrase[None, :], np.array([n]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_against_brute_force(docs, rows, bench, block):
    table, items = bench
    windows = {}
    for i, t in items:
        for w in fm_index.windows_of(t):
            windows.setdefault(w, set()).update(set() if i is None else {str(i)})
    want = Counter()
    for r in rows:
        n, hit, found = brute_hits(r[1], windows)
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[(r[0], n, hit, len(found), ids, hit > 0 and 20 * hit >= n)] += 1
    found = fm_index.report(docs, table, block=block).drop("_lm_id", "_lm_text")
    assert Counter(map(tuple, found.collect())) == want


def test_every_row_returns_at_every_benchmark_size(docs, rows, bench):
    assert len({(r[0], r[1]) for r in rows}) < len(rows)
    whole, parts = (
        Counter(map(tuple, fm_index.report(docs, bench[0], block=block).collect())) for block in (100_000, 7)
    )
    assert sum(parts.values()) == len(rows) and parts == whole


def test_clean_keeps_the_others(docs, rows, bench):
    kept = fm_index.clean(docs, bench[0])
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in fm_index.report(docs, bench[0]).where("contaminated").collect()}
    assert 0 in bad and 1 in bad
    assert {r.doc_id for r in kept.collect()} - {None} == {r[0] for r in rows} - bad - {None}


def test_empty_sides(docs, empty, bench, spark):
    assert fm_index.report(empty, bench[0]).count() == 0
    nothing = fm_index.report(docs, bench[0].limit(0))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == docs.count()


def test_cut_spans():
    assert fm_index.cut_spans("a b, c d", [(1, 3)]) == "a  d"


# --- sanitisation

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_base(text):
    out = []
    for at, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and sanitise.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), at, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    signs = list("ab.@-+ 0123456789()é")
    for _ in range(20000):
        text = "".join(rng.choice(signs, rng.integers(0, 40)))
        assert [(a, b, k) for a, b, k, _ in sanitise.base_spans(text)] == brute_base(text)
    assert sanitise.base_spans("a" * 200_000 + "@") == []
    assert sanitise.base_spans("1" * 200_000) == []


def test_revealing_terms_are_found(spark):
    texts = [f"project zanzibar led by boss{i % 2}@corp.example every day of the week" for i in range(6)]
    texts += ["every day of the week the others work " + str(i) for i in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    df = df.union(df.limit(0))
    found = {r.doc_id: r for r in sanitise.report(df).collect()}
    kinds = [s.split(":") for s in found[0].spans.split(",")]
    words = {texts[0][int(a) : int(b)]: k for k, a, b in kinds}
    assert words["boss0@corp.example"] == "email"
    assert "zanzibar" not in words or words["zanzibar"] in ("removed", "generalised")
    assert "week" not in words and found[35].spans == ""
    assert found[0].n_email == 1 and found[0].base_sha256 == hashlib.sha256(b"email:24:42").hexdigest()
    strict = sanitise.sanitised(df, generalise=0.3, remove=0.9).where("doc_id = 0").first()
    assert "<email>" in strict.text and "zanzibar" not in strict.text and strict.spans == "x"


def test_terms_against_brute_force(docs, rows):
    texts = list({(r[0], r[1]): r[1] or "" for r in rows}.values())  # repeated rows are one document
    near, holds = Counter(), Counter()
    for text in texts:
        spans = sanitise.base_spans(text)
        near.update({(e, t) for e, t, _, _ in sanitise.near_terms(text, spans)})
        holds.update({sanitise._digest(f"{k}:{v}") for _, _, k, v in spans})
    term = Counter(x for t in texts for x in {sanitise._digest(w.lower()) for w in sanitise._WORD.findall(t)})
    n = len(texts)
    want = {}
    for (e, t), both in near.items():
        share = math.log(n * both / (term[t] * holds[e])) / math.log(n / holds[e])
        if both >= 1 and share >= 0.5:
            want[e, t] = round(share, 9)
    found = sanitise.disclosures(docs, sanitise.find(docs), support=1, generalise=0.5)
    assert {(r.entity, r.term): round(r.disclosed, 9) for r in found.collect()} == want


@pytest.mark.parametrize("copies", [1, 2, 5, 50])
def test_copies_of_a_row_hide_no_term(spark, copies):
    rows = [(1, "zanzibar write to boss@corp.example")] * copies + [(2, "zanzibar and boss@corp.example")]
    rows += [(10 + i, f"plain words {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in sanitise.report(df).where("doc_id < 3").collect()}
    assert found[1].startswith("removed:0:8,") and found[2].startswith("removed:0:8,")


def test_terms_far_from_their_entity_are_found(spark):
    filler = " ".join(f"plain{i}" for i in range(40))
    texts = [f"Zanzibar {filler} zanzibar {filler} write to boss@corp.example" for _ in range(3)]
    texts += [f"{filler} {i} write to other{i}@corp.example" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(40, "tango a1@corp.example")] * 2 + [(None, "samba a2@corp.example"), (41, "samba a2@corp.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in sanitise.report(df).collect()}
    for i in range(3):
        at = [m.span() for m in re.finditer("zanzibar", texts[i].lower())]
        mail = texts[i].index("boss")
        assert found[i] == ",".join([f"removed:{a}:{b}" for a, b in at] + [f"email:{mail}:{mail + 17}"])
    assert found[10].startswith("email:") and "," not in found[10]
    assert found[40] == "email:6:21"  # repeated rows are one document
    assert found[41] == "removed:0:5,email:6:21" == found[None]


# --- language model


def test_base_scores_against_brute_force(docs, rows):
    tokens = [(r[1] or "").encode().lower().split() + [None] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    count = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r, ts, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want[(r[0], h, len(ts), sum(count[t] > 0 for t in ts), n, round(base, 6))] += 1
    found = lbl.scores(docs, classes=20).collect()
    assert Counter((*r[:5], round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


@pytest.mark.parametrize(("classes", "numbered"), [(20, 60), (64, 40), (12, 1 << 18)])
def test_scores_against_the_trained_model(docs, rows, monkeypatch, classes, numbered):
    """The score of every text from the model's class probabilities and the shares of other words."""
    seen = {}

    def frequent(table, own=lbl.frequent_words):
        seen["words"] = own(table, numbered)
        return seen["words"]

    def trained(*args, own=lbl.train):
        seen["trained"] = own(*args)
        return seen["trained"]

    monkeypatch.setattr(lbl, "frequent_words", frequent)
    monkeypatch.setattr(lbl, "train", trained)
    found = lbl.scores(docs, classes=classes).collect()
    model = seen["trained"][0]
    number = {w: i + 3 for i, w in enumerate(seen["words"][: model.classes - 3])}
    texts = {}
    for r in rows:
        ws = (r[1] or "").encode().lower().split()
        texts.setdefault(r[0], []).append(ws)
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in texts}
    others = Counter(w for i, all_ in texts.items() if not held[i] for ws in all_ for w in ws if w not in number)
    below = math.log10(sum(others.values()) + 0.1 * (len(others) + 1))
    want = defaultdict(list)
    for i, all_ in texts.items():
        for ws in all_:
            s = [lbl._START, lbl._START, *[number.get(w, lbl._OTHER) for w in ws], lbl._END]
            p = model.log_probabilities(np.array(list(zip(s[:-2], s[1:-1], strict=True))))
            own = float(p[np.arange(len(s) - 2), s[2:]].sum(dtype=np.float64)) / math.log(10)
            want[i].append(own + sum(math.log10(others[w] + 0.1) - below for w in ws if w not in number))
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.score)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-4, atol=1e-3)


def test_class_probabilities_sum_to_one(spark):
    model = lbl.LogBilinear(12, 4)
    model.start(np.full(12, 1 / 12))
    contexts = np.array([(a, b) for a in range(12) for b in range(12)])
    whole = np.exp(model.log_probabilities(contexts))
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-5) and not whole[:, lbl._START].any()
    norm = np.array([model.log_normalisers(first) for first in range(12)])
    assert np.allclose(norm, lbl.normalisers(spark, model, 5), atol=1e-6)
    at = np.arange(12)
    own = model.scores(at, at, np.full(12, 5)) - norm[at, at]
    assert np.allclose(own, model.log_probabilities(np.stack((at, at), axis=1))[:, 5], atol=1e-5)


def test_training_beats_unigrams_on_held_out_text():
    rng = np.random.default_rng(0)
    words = [3]
    for _ in range(60_000):  # each word says much about the next
        words.append(3 + (words[-1] - 3 + int(rng.integers(1, 3))) % 9)
    seqs = [np.concatenate(([2, 2], words[i : i + 50], [1])).astype(np.int16) for i in range(0, 60_000, 50)]
    share = np.bincount(np.concatenate([s[2:] for s in seqs]), minlength=12) + 0.5
    share = share / share.sum()
    model = lbl.LogBilinear(12, 8)
    model.start(share)
    model.train(lbl._contexts(iter(seqs[:1000]), 512), share, lbl.RATE, np.random.default_rng(1))
    held = seqs[1000:]
    norm = np.array([model.log_normalisers(first) for first in range(12)])
    own = np.mean([(model.scores(s[:-2], s[1:-1], s[2:]) - norm[s[:-2], s[1:-1]]).mean() for s in held])
    plain = np.mean([np.log(share)[s[2:]].mean() for s in held])
    assert own > plain + 0.3
