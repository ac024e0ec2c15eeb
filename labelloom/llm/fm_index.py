"""Benchmark decontamination with an FM-index per shard of the training texts.

A window is 13 consecutive words of a benchmark item (all words of a shorter item). Words of
documents that occur in no window can lie in no occurrence, so a document falls apart into
runs of window words; runs that are too short for any window of their words are left out. Each
task takes documents in shards of bounded size and indexes a shard's runs: suffix array,
Burrows-Wheeler transform, a wavelet matrix for ranks, and every 16th text position sampled. All windows are
searched backward at once; occurrences are located by walking to the next sampled position,
and their spans merged per document.

Windows are broadcast in blocks of at most ``BLOCK`` windows of at most 13 words; a larger
benchmark takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import KEY, doc_id, keyed, stored

WINDOW = 13
BLOCK = 100_000
SHARD_WORDS = 1 << 18
SAMPLE = 16

#: Everything in ASCII but digits and small letters separates words (capitals are lowered first).
_SPACED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered, in UTF-8."""
    return (text or "").encode().lower().translate(_SPACED).split()


def windows_of(text: str | None, length: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` by prefix doubling; the end sorts before every symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit) & 1
            prefix = np.concatenate(([0], np.cumsum(ones)))
            zeros = len(symbols) - int(prefix[-1])
            self.levels.append((bit, prefix, zeros))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times each symbol occurs in the first ``at`` places."""
        low, high = np.zeros_like(at), at
        for bit, prefix, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + prefix[low], low - prefix[low])
            high = np.where(one, zeros + prefix[high], high - prefix[high])
        return high - low


class FMIndex:
    """Full-text index of a sequence of symbols above 0; 0 is kept for the end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(np.asarray(text, np.int64), 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        top = int(text.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top))))
        self.ranks = WaveletMatrix(self.last, max(1, top.bit_length()))
        self.sampled = order % sample == 0
        self.positions = order[self.sampled]
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.ranks.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffix array per phrase; phrases are padded at the front.

        Symbols that the text lacks must not occur in the phrases.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for i in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > i) & (low < high))
            if not len(live):
                continue
            symbol = phrases[live, -1 - i]
            low[live] = self._step(symbol, low[live])
            high[live] = self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array, by walking back to sampled ones."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            rows[open_] = self._step(self.last[rows[open_]], rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.positions[self.sample_rank[rows]] + steps


class _Phrases:
    """Windows of one block as rows of word numbers (from 2), and the items that have them."""

    def __init__(self, windows: list[bytes], items: list[list]):
        split = [w.split(b" ") for w in windows]
        self.number = {w: i + 2 for i, w in enumerate(sorted({x for s in split for x in s}))}
        self.lengths = np.array([len(s) for s in split], np.int64)
        self.rows = np.zeros((len(split), int(self.lengths.max(initial=1))), np.int64)
        for row, s in zip(self.rows, split, strict=True):
            row[len(row) - len(s) :] = [self.number[x] for x in s]
        self.items = items
        #: The shortest window that holds each word.
        self.least = np.full(len(self.number) + 2, 1 << 30, np.int64)
        for row, length in zip(self.rows, self.lengths.tolist(), strict=True):
            words = row[len(row) - length :]
            self.least[words] = np.minimum(self.least[words], length)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, 0 for words that no window has."""
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def runs(self, numbers: np.ndarray) -> np.ndarray:
        """Starts and ends of the runs in which some window has room, one row each.

        A word can only be hit in a run at least as long as the shortest window that holds it,
        so the longest windows take their runs first and shorter ones look at what is left.
        """
        found = []
        left = numbers > 0
        for length in sorted(set(self.lengths.tolist()), reverse=True):
            left = left & (self.least[numbers] <= length) if found else left
            edge = np.flatnonzero(np.diff(left, prepend=False, append=False))
            runs = edge.reshape(-1, 2)
            runs = runs[runs[:, 1] - runs[:, 0] >= length]
            found.append(runs)
            if len(runs):
                taken = np.zeros(len(numbers) + 1, np.int64)
                taken[runs[:, 0]] += 1
                taken[runs[:, 1]] -= 1
                left = left & (np.cumsum(taken)[:-1] == 0)
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def find(self, numbers: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, place in numbers)`` of all occurrences; the shard is the runs joined by 1."""
        n = runs[:, 1] - runs[:, 0] + 1
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) + np.repeat(runs[:, 0] - begin, n)
        text = np.append(numbers, 0)[place]
        text[begin + n - 1] = 1
        index = FMIndex(text)
        there = np.zeros(len(self.number) + 2, bool)
        there[text] = True
        able = np.flatnonzero((there[self.rows] | (self.rows == 0)).all(axis=1))
        low, high = index.search(self.rows[able], self.lengths[able])
        count = np.maximum(0, high - low)
        which = np.repeat(able, count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, place[index.locate(rows)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(phrases: _Phrases, texts: list[str | None]) -> Iterator[tuple[int, list, list]]:
    """Per text: number of words, merged hit spans, items with occurring windows."""
    at = 0
    while at < len(texts):
        shard, size = [], 0
        while at < len(texts) and size < SHARD_WORDS:
            shard.append(np.append(phrases.numbers(words_of(texts[at])), 0))
            size += len(shard[-1])
            at += 1
        numbers = np.concatenate(shard)
        starts = np.cumsum([len(x) for x in shard]) - [len(x) for x in shard]
        spans: list[list] = [[] for _ in shard]
        found: list[set] = [set() for _ in shard]
        runs = phrases.runs(numbers)
        if len(runs):
            which, where = phrases.find(numbers, runs)
            doc = np.searchsorted(starts, where, side="right") - 1
            for w, d, word in zip(which.tolist(), doc.tolist(), (where - starts[doc]).tolist(), strict=True):
                spans[d].append((word, word + int(phrases.lengths[w])))
                found[d].update(phrases.items[w])
        for x, s, f in zip(shard, spans, found, strict=True):
            yield len(x) - 1, merged(s), list(f)


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _blocks(benchmark: DataFrame, window: int, block: int) -> list[tuple[list[bytes], list[list[str]]]]:
    """The distinct windows of the benchmark, in blocks of bounded size."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (w, None if pd.isna(i) else str(i))
                for i, t in zip(batch["item_id"], batch["text"], strict=True)
                for w in windows_of(t, window)
            ]
            yield pd.DataFrame(rows, columns=["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string"), "text")
    cuts = stored(items.mapInPandas(cut, "window binary, item string"), "benchmark-windows")
    count = max(1, -(-cuts.count() // block))
    pick = F.pmod(F.xxhash64("window"), F.lit(count))
    out = []
    for i in range(count):
        rows = cuts.where(pick == i).groupBy("window").agg(F.collect_set("item").alias("items")).collect()
        if rows:
            out.append(([bytes(r["window"]) for r in rows], [list(r["items"]) for r in rows]))
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: row key, ``doc_id, n_words, spans, items``.

    ``spans`` are the merged runs of hit words (word numbers, end exclusive), ``items`` the ids
    (as strings) of benchmark items with an occurring window. Null texts and texts without
    words have none. Items without words have no window; items that share a window both
    count; a null item_id is no item but its windows hit. Repeated rows give repeated rows,
    however many blocks the benchmark has. Empty tables are fine.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window, block) or [([], [])]
    schema = f"_lm_id long, _lm_text long, {_FOUND}"
    passes = []
    for windows in blocks:
        shared = spark.sparkContext.broadcast(windows)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            phrases = _Phrases(*shared.value)
            for batch in batches:
                found = list(_scan(phrases, batch["text"].tolist()))
                out = batch.drop(columns="text")
                out["n_words"] = np.array([x[0] for x in found], np.int64)
                out["spans"] = [[{"start": a, "end": b} for a, b in x[1]] for x in found]
                out["items"] = [x[2] for x in found]
                yield out

        passes.append(keyed(docs, "text").mapInPandas(scan, schema))
    if len(passes) == 1:
        return passes[0].withColumn("doc_id", doc_id())
    union = passes[0]
    for other in passes[1:]:
        union = union.union(other)
    # Repeated rows find the same in a pass; sets hold it once, and the rows come back after.
    together = union.groupBy(*KEY).agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    together = together.withColumn("spans", _merge("spans"))
    return keyed(docs).join(together, KEY, "left").withColumn("doc_id", doc_id())


def _merge(spans: str):
    pair = "array<struct<start:long,end:long>>"

    @F.pandas_udf(pair)
    def merge(rows: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row])] for row in rows]
        )

    return merge(spans)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and its row key.

    Contaminated: hit words are at least a twentieth of the words, and not none.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = occurrences(docs, benchmark, window, block).withColumn("n_hit", hit)
    return found.select(
        *KEY,
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents without the contaminated ones; all columns, rows and texts else unchanged."""
    bad = report(docs, benchmark, window, block).where("contaminated").select(*KEY)
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed(docs, F.struct(*own).alias("_lm_row"))
    return rows.join(bad.distinct(), KEY, "left_anti").select(
        *[F.col("_lm_row").getField(c).alias(c) for c in docs.columns]
    )


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans; what stands between other words stays."""
    import re

    text = text or ""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])
