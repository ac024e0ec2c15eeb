"""Token alignment against links formed one by one with the libraries' own encoders."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelloom.llm import alignment

A_PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
B_PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.signs = alignment.byte_alphabet()

    def groups(self, text):
        """Lists of A ids and B ids per group, or None."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.signs[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        out, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            out.append(
                (
                    [i for i, e in zip(a, ends_a, strict=True) if start < e <= cut],
                    [i for i, e in zip(b, ends_b, strict=True) if start < e <= cut],
                )
            )
            start = cut
        return out


def brute(texts):
    plain = Plain()
    found = {t: plain.groups(t) for t in set(texts)}
    links = {t: [(x, y) for a, b in g or [] for x in a for y in b] for t, g in found.items()}
    count = Counter(p for t in texts for p in set(links[t]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for t in texts:
        g = found[t] or []
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append(
            (
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                len(links[t]),
                sum(count[p] == best[p[0]] for p in links[t]),
                sum(count[p] for p in links[t]),
                hashlib.sha256(written.encode()).hexdigest() if g else "",
            )
        )
    return out


EXTRA = [
    "<|endoftext|> and <s> </s> <unk>", "a▁b", "▁", " ", "  two  spaces  ", "line\nends\r\n\n here", "\t tabs",
    "naïve café 漢字かな 😀😀 مرحبا", "x" * 300, "=" * 500, "1234567890" * 9, "don't we'll I've", "a\x00b", "<0x41>",
]


@pytest.mark.parametrize("table", [1 << 20, 40, 1])
def test_alignment_against_brute_force(spark, docs, rows, table):
    extra = [(1000 + i, t) for i, t in enumerate(EXTRA)] + [(2000, EXTRA[7])] * 2
    cells = [(r[0], r[1]) for r in rows] + extra
    more = spark.createDataFrame(extra, "doc_id long, text string")
    df = docs.select("doc_id", "text", "size").unionByName(more, allowMissingColumns=True)
    want = Counter((i, *m) for (i, _), m in zip(cells, brute([t for _, t in cells]), strict=True))
    found = alignment.measured(df, A_PATH, B_PATH, table)
    assert Counter(map(tuple, found.collect())) == want


def test_encoders_equal_the_libraries():
    plain, own = Plain(), alignment.Aligner(A_PATH, B_PATH)
    rng = random.Random(4)
    signs = [chr(c) for c in (*range(1, 0x250), *range(0x3B0, 0x400), 0x2028, 0x3000, 0x4E00, 0x1F600, 0xA0)]
    common = list("   \n\tab'stre09.,=_-<>|▁")
    for _ in range(1500):
        text = "".join(rng.choice(common if rng.random() < 0.6 else signs) for _ in range(rng.randrange(1, 40)))
        (found,) = own.units.encode([text])
        a, b = plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text)
        assert (None if plain.groups(text) is None else (a, b)) == (found and tuple(x.tolist() for x in found))


def test_wide_groups_count_alike(monkeypatch):
    own = alignment.Aligner(A_PATH, B_PATH)
    text = " ".join(EXTRA)
    narrow = own.align(text)
    monkeypatch.setattr(alignment, "_WIDE", 1)
    wide = own.align(text)
    assert narrow[:5] == wide[:5]
    assert (narrow[5] == wide[5]).all() and (narrow[6] == wide[6]).all() and wide[6].sum() == wide[3]


def test_no_documents_no_measures(empty, spark):
    assert alignment.measured(empty, A_PATH, B_PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.measured(nulls, A_PATH, B_PATH).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_merges_out_of_order_are_refused(tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}')
    with pytest.raises(ValueError, match="order"):
        alignment.ByteTokenizer(str(path))


def test_hot_keys_join_like_others(spark):
    from labelloom.llm.common import joined_hot

    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(300)], "row long, k long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", rows.k * 2)
    for most in (1, 10, 10_000):
        found = joined_hot(rows, table, "k", "n", most).select("row", "v").collect()
        assert sorted(map(tuple, found)) == [(i, 0 if i % 3 == 0 else 2 * i) for i in range(300)]
