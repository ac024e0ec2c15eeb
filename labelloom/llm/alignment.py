"""Alignment of two tokenizers over a corpus, once per distinct text.

Tokenizer A is a byte-level BPE that reads a space and the text, B a sentencepiece model that
puts the space there itself. Where tokens of both end at the same byte a group ends; every A
token of a group is linked to every B token of it.

Texts are shuffled by their full content, so that copies meet and each distinct text is
tokenised and aligned once. Its pairs of ids count as often as the text occurs. Documents get
the measures of their text by a digest of it.

A document's measures need the corpus-wide count of each of its pairs. Pairs that hold more
than one in ``TABLE`` of all counts are at most ``TABLE`` many and are looked up in a broadcast
table; the others, of which none is frequent, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import discard, joined_hot, stored
from labelloom.llm.token_counts import CACHE_ROWS

#: Frequent pairs that are broadcast at most: 16 MB.
TABLE = 1 << 20
_CHUNK_PAIRS = 1 << 19
_CHUNK_CHARS = 1 << 20
#: Links of one group beyond which it is counted by distinct ids, not link by link.
_WIDE = 1 << 12

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Printable Latin-1 signs are themselves; the other bytes follow from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level BPE out of a tokenizers file; special strings in a text are plain text.

    Its merges must be in the order of their ids, as ranks are all that the encoder is given.
    """

    def __init__(self, path: str, words: str = WORDS) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = byte_alphabet()
        vocabulary = model["vocab"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("merges must be in the order of their ids")
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("byte", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, units: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(u) for u in units]


class PieceTokenizer:
    """A sentencepiece model with byte fallback and identity normaliser."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]

    def encode(self, units: list[str]) -> list[list[int]]:
        # A line end before a unit keeps the space that the model adds apart from it.
        return [ids[2:] for ids in self.model.encode(["\n" + u for u in units], num_threads=1)]


#: Between two units of a text a token of either tokenizer ends: before a single space between
#: two characters that are no white space.
_UNIT = re.compile(r"(?<=\S)(?= \S)")


class Units:
    """Ids of the units of texts in both tokenizers; a task encodes each unit once.

    The cache starts again when it holds ``CACHE_ROWS`` units. A unit that the pieces do not give
    back byte for byte is broken; byte-level tokens always give theirs back.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer) -> None:
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        self.ids_a: dict[str, bytes] = {}
        self.ids_b: dict[str, bytes] = {}
        self.broken: set[str] = set()

    def _add(self, units: list[str]) -> None:
        token = self.b.tokens.__getitem__
        for unit, a, b in zip(units, self.a.encode(units), self.b.encode(units), strict=True):
            self.ids_a[unit] = array("i", a).tobytes()
            self.ids_b[unit] = array("i", b).tobytes()
            if b"".join(map(token, b)) != unit.encode():
                self.broken.add(unit)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text in both, or None where the pieces do not give the text back."""
        if len(self.ids_a) > CACHE_ROWS:
            self._clear()
        # The piece model reads its own sign for a space as a space.
        split = [None if "▁" in t else _UNIT.split(" " + t) for t in texts]
        new = list({u for units in split if units for u in units if u not in self.ids_a})
        if new:
            self._add(new)
        for units in split:
            if units is None or not self.broken.isdisjoint(units):
                yield None
            else:
                ids = (b"".join(map(x.__getitem__, units)) for x in (self.ids_a, self.ids_b))
                yield tuple(np.frombuffer(x, np.int32).astype(np.int64) for x in ids)


class Aligner:
    """Both tokenizers, and the alignment of one text at a time."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.units = Units(self.a, self.b)
        self.size_b = len(self.b.tokens)
        self.long_a, self.long_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        # Every id written with each sign that may follow it.
        self.signs_a = np.array([f"{i}{s}" for i in range(len(self.a.tokens)) for s in ",|"], object)
        self.signs_b = np.array([f"{i}{s}" for i in range(self.size_b) for s in ",;"], object)

    def align(self, text: str | None) -> tuple:
        """Measures, groups and pairs of one text; see :meth:`align_ids`."""
        return self.align_ids(next(self.units.encode([text])) if text else None)

    def align_ids(self, ids: tuple[np.ndarray, np.ndarray] | None) -> tuple:
        """``(n_a, n_b, n_groups, n_links, groups, pairs, links)``: the groups as text, the distinct
        pairs as ``a * size_b + b`` in order, and the links of each."""
        if ids is None:
            return 0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = ids
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        at = np.searchsorted(end_b, end_a)
        ends = end_a[end_b[at] == end_a]
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        pairs, links = self._pairs(a, b, group_a, group_b, in_a, in_b)
        return len(a), len(b), len(ends), int((in_a * in_b).sum()), self._written(a, b, group_a, group_b), pairs, links

    def _pairs(self, a, b, group_a, group_b, in_a, in_b) -> tuple[np.ndarray, np.ndarray]:
        wide = in_a * in_b > _WIDE
        starts_a, starts_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        keep = ~wide[group_a]
        own, groups = a[keep], group_a[keep]
        n = in_b[groups]
        first = np.repeat(starts_b[groups] - (np.cumsum(n) - n), n)
        codes = [np.repeat(own, n) * self.size_b + b[first + np.arange(int(n.sum()))]]
        counts = [np.ones(len(codes[0]), np.int64)]
        for g in np.flatnonzero(wide):
            ids_a, n_a = np.unique(a[starts_a[g] : starts_a[g] + in_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[starts_b[g] : starts_b[g] + in_b[g]], return_counts=True)
            codes.append((ids_a[:, None] * self.size_b + ids_b).ravel())
            counts.append((n_a[:, None] * n_b).ravel())
        if len(codes) == 1:
            return np.unique(codes[0], return_counts=True)
        pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, at, np.concatenate(counts))
        return pairs, links

    def _written(self, a, b, group_a, group_b) -> str:
        last_a = np.append(group_a[1:] != group_a[:-1], True).astype(np.int64)
        last_b = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        signs = np.concatenate((self.signs_a[2 * a + last_a], self.signs_b[2 * b + last_b]))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        return "".join(signs[order].tolist())[:-1]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(key, text, n)``: every distinct text that is not empty, and how many documents hold it."""
    counted = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_key().alias("key"), "text", "n")


def _key():
    return F.unhex(F.md5("text"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows about a million characters of text at a time."""
    for batch in batches:
        part = (batch["text"].map(len).cumsum() // _CHUNK_CHARS).to_numpy()
        for _, rows in batch.groupby(part):
            yield rows


def alignments(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per distinct text its measures, groups digest, and distinct pairs ``a, b`` with their links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(byte_path, piece_path)
        rows, size = [], 0
        names = ["key", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "links"]
        for part in _chunks(batches):
            found = aligner.units.encode(part["text"].tolist())
            for key, n, ids in zip(part["key"], part["n"].tolist(), found, strict=True):
                *measures, groups, pairs, links = aligner.align_ids(ids)
                digest = "" if groups is None else hashlib.sha256(groups.encode()).hexdigest()
                a, b = np.divmod(pairs, aligner.size_b)
                rows.append((key, n, *measures, digest, a.astype(np.int32), b.astype(np.int32), links.astype(np.int32)))
                size += len(pairs)
                if size >= _CHUNK_PAIRS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(
        run,
        "key binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " a array<int>, b array<int>, links array<int>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, count)``: documents that hold each pair linked, copies counted."""
    pairs = aligned.select("n", F.inline(F.arrays_zip("a", "b")))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))


def _looked_up(aligned: DataFrame, counts: DataFrame, table: int) -> DataFrame:
    """Sums over the pairs of each text; pairs that the table lacks come back in lists."""
    spark = aligned.sparkSession
    best = counts.groupBy("a").agg(F.max("count").alias("best")).toArrow()  # a row per id of A at most
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("count") * table > total).toArrow()  # at most `table` rows
    a, b, n = (often[c].to_numpy().astype(np.int64) for c in ("a", "b", "count"))
    order = np.lexsort((b, a))
    highest = np.zeros(int(best["a"].to_numpy().max(initial=0)) + 1, np.int64)
    highest[best["a"].to_numpy()] = best["best"].to_numpy()
    shared = spark.sparkContext.broadcast(((a[order] << 32) | b[order], n[order], highest))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, known, highest = shared.value
        for batch in batches:
            out = batch.drop(columns=["a", "b", "links"])
            lengths = batch["a"].map(len).to_numpy()
            a, b, links = (
                np.concatenate([np.zeros(0, np.int64), *batch[c]]).astype(np.int64) for c in ("a", "b", "links")
            )
            code = (a << 32) | b
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            count = np.where(hit, known[at] if len(codes) else 0, 0)
            is_best = hit & (count == highest[a])
            edges = np.concatenate(([0], np.cumsum(lengths)))
            for name, values in (("n_best", links * is_best), ("count_sum", links * count)):
                out[name] = np.diff(np.concatenate(([0], np.cumsum(values)))[edges])
            missed = ~hit
            for name, values in (("rest_a", a), ("rest_b", b), ("rest_links", links), ("rest_best", highest[a])):
                out[name] = [values[i:j][missed[i:j]] for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield out

    names = [x for x in aligned.schema if x.name not in ("a", "b", "links")]
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in names)
    return aligned.mapInPandas(
        look,
        f"{schema}, n_best long, count_sum long, rest_a array<int>, rest_b array<int>,"
        " rest_links array<int>, rest_best array<long>",
    )


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def measured(docs: DataFrame, byte_path: str, piece_path: str, table: int = TABLE) -> DataFrame:
    """Per document: ``doc_id``, :data:`MEASURES` and ``groups_sha256``.

    Texts that are null, empty, or not given back by both tokenizers byte for byte have no
    tokens: zeros and an empty digest. Repeated rows all return and all count. An empty table
    gives no rows. Both paths must be readable by every worker.
    """
    texts = distinct_texts(docs)
    aligned = stored(alignments(texts, byte_path, piece_path), "alignments")
    counts = stored(pair_counts(aligned), "pair-counts")
    sums = stored(_looked_up(aligned, counts, table), "alignment-sums")
    discard(aligned)
    rest = sums.where(F.size("rest_a") > 0).select(
        "key", F.inline(F.arrays_zip("rest_a", "rest_b", "rest_links", "rest_best"))
    )
    rest = rest.join(counts, (F.col("rest_a") == F.col("a")) & (F.col("rest_b") == F.col("b")))
    rest = rest.groupBy("key").agg(
        F.sum(F.when(F.col("count") == F.col("rest_best"), F.col("rest_links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("rest_links") * F.col("count")).alias("more_sum"),
    )
    whole = sums.join(rest, "key", "left").withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        }
    )
    whole = stored(whole.select("key", "n", *MEASURES, "groups_sha256"), "alignment-measures")
    discard(sums)
    discard(counts)
    own = docs.select("doc_id", F.when(F.col("text") != "", _key()).alias("key"))
    found = joined_hot(own.where("key IS NOT NULL"), whole, "key", "n")
    bare = own.where("key IS NULL").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("groups_sha256"))
    return found.select("doc_id", *MEASURES, "groups_sha256").union(bare)
