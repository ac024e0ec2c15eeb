"""Exact substring dedup: every byte under a repeated 200-byte string goes.

Candidates come from content. Each 200-byte string marks the 96-byte gram with the smallest
hash in it (all of them, on a tie), so equal strings mark equal grams at equal offsets, and
only strings around a gram that is marked twice can repeat. The surroundings of such a gram
(every 200-byte string that holds it) are a piece; pieces of one gram meet in one task, equal
pieces counted as one.

There the pieces get an enhanced suffix array: what follows the gram, sorted, with the common
prefixes of neighbours. A stack scan walks its interval tree of common prefixes. The members of
an interval are tested for how diverse they are to the left: sorted by what precedes the gram,
read backward, they fall into runs that share enough to make 200 bytes together with the
interval's prefix. A run is a maximal repeat, all its members are its occurrences, and each
covers its common extensions to both sides. A gram with one piece only, often marked, needs no
array: its piece repeats as a whole.

A gram with more than ``PIECES`` different pieces (the edge of a passage that very many
documents share) is not gathered in a task: its strings are grouped one by one, by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import KEY, in_filter, keyed, membership_filter, stored

LENGTH = 200
GRAM = 96
PIECES = 1 << 17
BATCH_BYTES = 1 << 20
REPEAT_BITS = 1 << 26
HOT_BITS = 1 << 20
_P = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def gram_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a hash of that many bytes from each place on, built by doubling."""
    out: list[np.ndarray | None] = [None] * len(sizes)
    done = [0] * len(sizes)
    with np.errstate(over="ignore"):
        part, width = data.astype(np.uint64) + np.uint64(1), 1
        while width <= max(sizes) and len(part):
            for i, size in enumerate(sizes):
                if size & width:
                    if out[i] is None:
                        out[i] = part
                    else:
                        n = max(0, min(len(out[i]), len(part) - done[i]))
                        out[i] = out[i][:n] * _power(width) + part[done[i] : done[i] + n]
                    done[i] += width
            part = part[:-width] * _power(width) + part[width:] if len(part) > width else part[:0]
            width *= 2
        for i, size in enumerate(sizes):
            whole = out[i] if out[i] is not None and len(data) >= size else np.zeros(0, np.uint64)
            whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            out[i] = whole ^ (whole >> np.uint64(29))
    return out


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    n = len(values)
    blocks = np.append(values, np.repeat(values[-1], -n % width)).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def marks(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams marked in strings of ``width`` grams, from the grams' hashes."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _sliding(h, width, np.minimum)
    # A place is marked if it is the least of some string that holds it.
    edge = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    return np.flatnonzero(reach == h)


class _Text:
    """A text with its marked grams and digests of the pieces around them."""

    def __init__(self, text: str | None, length: int, gram: int):
        self.data = (text or "").encode()
        # A piece is no longer than two strings, so its first and last string tell it.
        grams, self.strings = gram_hashes(np.frombuffer(self.data, np.uint8), gram, length)
        self.at = marks(grams, length - gram + 1)
        self.g = grams[self.at].view(np.int64)
        self.low = np.maximum(0, self.at - (length - gram))
        self.high = np.minimum(len(self.data), self.at + length)

    def select(self, places: np.ndarray) -> None:
        self.at, self.g, self.low, self.high = (x[places] for x in (self.at, self.g, self.low, self.high))

    def digests(self, length: int) -> np.ndarray:
        """Digests of the pieces; the gram's offset is part of them."""
        parts = (self.strings[self.low], self.strings[self.high - length], self.at - self.low, self.high - self.at)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.at), np.uint64)
            for part in parts:
                total = (total ^ part.astype(np.uint64)) * np.uint64(_P)
                total ^= total >> np.uint64(31)
        return total.view(np.int64)


def _counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(g, n, least, most, pieces)``: marks of each gram, the smallest and largest digest of its
    pieces, and a bound of the number of different pieces."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch["text"]:  # one at a time: the hashes of a text are far larger than itself
                found = _Text(text, length, gram)
                grams.append(found.g)
                digests.append(found.digests(length))
            h, d = np.concatenate(grams), np.concatenate(digests)
            if len(h):
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                last = np.append(first[1:], len(h)) - 1
                fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
                most = pd.array(d[last], "Int64")
                most[d[last] == d[first]] = None
                yield pd.DataFrame(
                    {
                        "g": h[first],
                        "n": last - first + 1,
                        "least": d[first],
                        "most": most,
                        "pieces": np.add.reduceat(fresh.astype(np.int64), first),
                    }
                )

    parts = docs.select("text").mapInPandas(count, "g long, n long, least long, most long, pieces long")
    return parts.groupBy("g").agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max(F.coalesce("most", "least")).alias("most"),
        F.sum("pieces").alias("pieces"),
    )


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(row key, at, g)`` of every marked gram."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                found = [_Text(t, length, gram) for t in part["text"]]
                n = [len(t.at) for t in found]
                yield pd.DataFrame(
                    {
                        "_lm_id": np.repeat(part["_lm_id"].to_numpy(), n),
                        "_lm_text": np.repeat(part["_lm_text"].to_numpy(), n),
                        "at": np.concatenate([t.at for t in found]),
                        "g": np.concatenate([t.g for t in found]),
                    }
                )

    return keyed(docs, "text").mapInPandas(mark, "_lm_id long, _lm_text long, at long, g long")


def _candidates(docs: DataFrame, counts: DataFrame, length: int, gram: int, bits: int):
    """Documents with their repeated places to be looked at, and a function that finds them.

    Repeated grams are looked up in a broadcast filter while they are few enough for it (a
    sixteenth of its bits); beyond that, places are joined to them and brought to their text.
    """
    spark = docs.sparkSession
    if counts.count() <= bits >> 4:
        words = spark.sparkContext.broadcast(membership_filter(counts, "g", bits))

        def places(text: str | None, _) -> _Text:
            found = _Text(text, length, gram)
            found.select(in_filter(words.value, found.g))
            return found

        return keyed(docs, "text").withColumn("places", F.lit(None).cast("array<long>")), places
    lists = _marked(docs, length, gram).join(counts.select("g"), "g")
    lists = lists.groupBy(*KEY).agg(F.collect_set("at").alias("places"))

    def listed(text: str | None, rows) -> _Text:
        found = _Text(text, length, gram)
        found.select(np.isin(found.at, np.asarray(rows, np.int64)))
        return found

    return keyed(docs, "text").join(lists, KEY), listed


def _units(text: _Text, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(key, digest, first byte, end, gram's offset)`` of the pieces, or strings, to compare.

    A string of a hot gram has the offset -1, and the offset of the gram in it in its key, which
    keeps it apart from itself around another equal gram.
    """
    whole = ~hot
    units = [
        (text.g[whole], text.digests(length)[whole], text.low[whole], text.high[whole], (text.at - text.low)[whole])
    ]
    for a, g, low, high in zip(*(x[hot].tolist() for x in (text.at, text.g, text.low, text.high)), strict=True):
        start = np.arange(low, min(a, high - length) + 1)
        h = text.strings[start]
        with np.errstate(over="ignore"):
            k = (np.uint64(g % (1 << 64)) ^ (h * np.uint64(31))) + (a - start).astype(np.uint64) * np.uint64(_P)
        units.append((k.view(np.int64), h.view(np.int64), start, start + length, np.full(len(start), -1)))
    return tuple(np.concatenate(x) for x in zip(*units, strict=True))


def _pieces(rows: DataFrame, places, mixed, hot, length: int) -> DataFrame:
    """``(k, h, n, off, piece)``: different pieces of a task with their number, of grams with
    several pieces; strings of hot grams come without their bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list] = {}
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["k", "h", "n", "off", "piece"])

        for batch in batches:
            for text, listed in zip(batch["text"], batch["places"], strict=True):
                found = places(text, listed)
                found.select(in_filter(mixed.value, found.g))
                units = _units(found, in_filter(hot.value, found.g), length)
                for k, h, low, high, off in zip(*(x.tolist() for x in units), strict=True):
                    if (k, h) in seen:
                        seen[k, h][0] += 1
                    else:
                        piece = found.data[low:high] if off >= 0 else None
                        seen[k, h] = [1, off, piece]
                        size += 100 + len(piece or b"")
                if size > 16 * BATCH_BYTES:
                    yield out()
                    seen, size = {}, 0
        if seen:
            yield out()

    return rows.select("text", "places").mapInPandas(cut, "k long, h long, n long, off int, piece binary")


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


def intervals(rows: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(depth, low, high)`` of the interval tree of sorted rows: rows ``low`` to ``high - 1``
    share ``depth`` bytes and neither neighbour does; children come before their parents."""
    depths = [shared(a, b) for a, b in zip(rows, rows[1:], strict=False)]
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*depths, -1]):
        low = i
        while stack and stack[-1][0] > depth:
            size, low = stack.pop()
            yield size, low, i + 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


def extensions(pieces: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """How far each piece (bytes, gram's offset) repeats to the left and right of its gram.

    Both are 0 if no string of ``length`` bytes around the gram occurs in another piece.
    """
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][0][pieces[i][1] :])
    right = [pieces[i][0][pieces[i][1] :] for i in order]
    back = [pieces[i][0][: pieces[i][1]][::-1] for i in order]
    reach = [(0, 0)] * len(pieces)
    for depth, low, high in intervals(right):
        members = sorted(range(low, high), key=back.__getitem__)
        before = 0
        for at, member in enumerate(members):
            after = shared(back[member], back[members[at + 1]]) if at + 1 < len(members) else 0
            left = max(before, after)
            if left + depth >= length:
                own = reach[order[member]]
                reach[order[member]] = (max(own[0], left), max(own[1], depth))
            before = after
    return reach


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def covers(rows: list[tuple], length: int = LENGTH) -> Iterator[tuple[int, int, list]]:
    """``(k, h, spans)`` of covered bytes, from rows ``(k, h, n, off, piece)`` of one key."""
    distinct: dict[int, list] = {}
    for k, h, n, off, piece in rows:
        if h in distinct:
            distinct[h][0] += n
        else:
            distinct[h] = [n, off, piece]
    several = [(h, off, piece) for h, (_, off, piece) in distinct.items() if piece is not None]
    reach = extensions([(piece, off) for _, off, piece in several], length) if len(several) > 1 else []
    sides = {h: (off, *r) for (h, off, _), r in zip(several, reach, strict=False)}
    for h, (n, _, piece) in distinct.items():
        if n > 1:
            yield k, h, [(0, length if piece is None else len(piece))]
        elif h in sides and sides[h][2]:
            off, left, right = sides[h]
            yield k, h, [(off - left, off + right)]


def _covered(pieces: DataFrame, length: int) -> DataFrame:
    """``(k, h, spans)`` for every piece or string with repeated bytes."""

    def spanned(found: list) -> pd.DataFrame:
        listed = [(k, h, [{"a": a, "b": b} for a, b in s]) for k, h, s in found]
        return pd.DataFrame(listed, columns=["k", "h", "spans"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in ("k", "h", "n", "off", "piece")]
            for row in zip(*columns, strict=True):
                if rows and row[0] != rows[0][0]:
                    out.extend(covers(rows, length))
                    rows = []
                rows.append(row)
            yield spanned(out)
        if rows:
            yield spanned(list(covers(rows, length)))

    sorted_ = pieces.repartition("k").sortWithinPartitions("k", "h")
    return sorted_.mapInPandas(search, "k long, h long, spans array<struct<a:int,b:int>>")


def _occurrences(rows: DataFrame, places, mixed, hot, length: int) -> DataFrame:
    """``(k, h, row key, low, high)``: where each piece or string stands.

    Strings are taken of the grams that both filters pass, as in ``_pieces``; a gram with one
    piece that only the hot filter passes keeps its whole piece.
    """

    def where(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                texts = [places(t, p) for t, p in zip(part["text"], part["places"], strict=True)]
                split = [in_filter(mixed.value, t.g) & in_filter(hot.value, t.g) for t in texts]
                units = [_units(t, x, length)[:4] for t, x in zip(texts, split, strict=True)]
                n = [len(u[0]) for u in units]
                out = {c: np.concatenate(x) for c, x in zip(("k", "h", "low", "high"), zip(*units), strict=True)}
                out |= {c: np.repeat(part[c].to_numpy(), n) for c in KEY}
                yield pd.DataFrame(out)[["k", "h", *KEY, "low", "high"]]

    return rows.select(*KEY, "text", "places").mapInPandas(
        where, "k long, h long, _lm_id long, _lm_text long, low int, high int"
    )


def removals(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    pieces: int = PIECES,
    bits: int = REPEAT_BITS,
    hot_bits: int = HOT_BITS,
) -> DataFrame:
    """``(row key, spans)``: covered byte spans of the texts, unmerged, rows without any left out."""
    spark = docs.sparkSession
    counts = stored(_counts(docs, length, gram).where("n > 1"), "repeated-grams")
    rows, places = _candidates(docs, counts, length, gram, bits)
    # Whatever a filter passes beyond its members is looked at in another, no less exact way.
    mixed = counts.where("least <> most")
    mixed_filter = spark.sparkContext.broadcast(membership_filter(mixed, "g", bits))
    hot = spark.sparkContext.broadcast(membership_filter(mixed.where(F.col("pieces") > pieces), "g", hot_bits))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(1 << 30).alias("b")))
    single = counts.where("least = most").select(F.col("g").alias("k"), F.col("least").alias("h"), whole.alias("spans"))
    found = stored(_covered(_pieces(rows, places, mixed_filter, hot, length), length), "repeated-pieces")
    where = _occurrences(rows, places, mixed_filter, hot, length).join(found.union(single), ["k", "h"])
    span = F.transform(
        "spans",
        lambda s: F.struct((F.col("low") + s["a"]).alias("a"), F.least(F.col("low") + s["b"], F.col("high")).alias("b")),
    )
    return where.groupBy(*KEY).agg(F.flatten(F.collect_list(span)).alias("_lm_spans"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many go, and in how many runs."""
    runs = merged(spans)
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), sum(b - a for a, b in runs), len(runs)


def report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null texts are empty. Repeated rows repeat each other's strings, so their long texts go.
    Texts of fewer than ``length`` bytes lose nothing. An empty table gives no rows.
    """

    @F.pandas_udf("struct<removed:long,spans:long,sha:string>")
    def judge(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, listed in zip(texts, spans, strict=True):
            if listed is None:
                out.append((0, 0, None))
                continue
            kept, removed, runs = cut(text.encode(), [(s["a"], s["b"]) for s in listed])
            out.append((removed, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["removed", "spans", "sha"])

    text = F.coalesce("text", F.lit(""))
    rows = keyed(docs, "doc_id", "text").join(removals(docs, length, **options), KEY, "left")
    touched = F.when(F.col("_lm_spans").isNotNull(), F.col("text"))
    judged = rows.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.when(F.col("_lm_spans").isNull(), F.sha2(text, 256)).alias("whole"),
        judge(touched, F.col("_lm_spans")).alias("j"),
    )
    return judged.select(
        "doc_id",
        "n_bytes",
        F.col("j.removed").alias("n_removed"),
        F.col("j.spans").alias("n_spans"),
        F.coalesce("j.sha", "whole").alias("kept_sha256"),
    )
