"""Near-duplicate lines by MinHash; one line of each group stays.

Lines are compared in lower case with white space runs as one space. Their shingles are 9
characters (a shorter line is one shingle). A line gets one hash per shingle, dealt over 24
bins of which each keeps its smallest (empty bins borrow from the next), and three bins make a
band: with 8 bands, lines of Jaccard similarity 0.8 meet in some band with probability 0.997.

Lines that agree in a band are a list. Its pairs are not formed: every member is paired with
the list's smallest line, first within each task, so that a list sends at most one entry per
group of lines read together, then over all tasks. Pairs are verified by the exact Jaccard
similarity of their shingle sets, shingles told apart by 64-bit hashes, and joined by a
distributed union-find.

Most lines stand alone, so what a line leaves behind travels as packed arrays: the scan writes
its entries in blocks, and blocks are dealt by ranges of their key to as many parts as the
number of entries asks for. Only lists of several lines and lines that go become rows.

A list may still hold several groups: lines that are near some members but not its smallest
line. The lines of such lists are dealt anew over 20 bands of 6 bins each, where lines of
similarity 0.8 meet with probability 0.998 and lines of 0.6 seldom do. In every such list the
members are paired with one leader, drawn by a hash of list and line, so that the leaders of
a group of lines differ from band to band. Pairs grow with the lines, not with the square of a
group; a near pair that shares no leader in any band may stay apart (README has figures).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.llm.common import (
    KEY,
    NO_ID,
    discard,
    in_filter,
    joined_hot,
    keyed,
    membership_filter,
    stored,
)
from labelloom.llm.components import components

SHINGLE = 9
SIMILARITY = 0.8
BANDS = 8
ROWS = 3
FINE_BANDS = 20
FINE_ROWS = 6
_GROUP_CHARS = 1 << 20
_GROUP_LINES = 50_000
_HASH_CHARS = 1 << 16
_SET_CHARS = 1 << 19
_PART = 200_000
_DEAL = 1_000_000
_HIGH = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = np.uint64(0x100000001B3)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    """Signed 64-bit digest of a line in normal form."""
    value = xxhash.xxh3_64_intdigest(line.encode())
    return value - (1 << 64) if value >> 63 else value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _by_chars(lines: list[str], chars: int = _HASH_CHARS) -> Iterator[slice]:
    """Runs of lines of about so many characters, whose arrays stay in a core's cache."""
    start = size = 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(lines):
        yield slice(start, len(lines))


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some lines, and the number of the line each belongs to."""
    # A line is padded with zeros up to one shingle, which keeps short lines apart.
    padded = np.array([max(len(x), size) for x in lines], np.int64)
    chars = np.frombuffer("".join([x.ljust(size, "\0") for x in lines]).encode("utf-32-le"), np.uint32)
    chars = chars.astype(np.uint64)
    total = max(0, len(chars) - size + 1)
    with np.errstate(over="ignore"):
        # The polynomial over `size` characters, put together from runs of 1, 2, 4, ...
        h, done = np.zeros(total, np.uint64), 0
        run, width, factor = chars, 1, _P
        while done < size:
            if size & width:
                h = h * factor + run[done : done + total]
                done += width
            if 2 * width <= size:
                run = run[: len(run) - width] * factor + run[width:]
                factor = factor * factor
            width *= 2
        inside = np.ones(total, bool)
        ends = np.cumsum(padded)[:-1]
        inside[(ends[:, None] - np.arange(1, size)).ravel()] = False
        return _mixed(h[inside]), np.repeat(np.arange(len(lines)), padded - size + 1)


def band_keys(lines: list[str], size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One int64 key per line and band."""
    keys = [_band_keys(lines[part], size, bands, rows) for part in _by_chars(lines)]
    return np.concatenate(keys) if keys else np.zeros((0, bands), np.int64)


def _band_keys(lines: list[str], size: int, bands: int, rows: int) -> np.ndarray:
    bins = bands * rows
    h, owner = shingle_hashes(lines, size)
    low = np.full(len(lines) * bins, _HIGH)
    slot = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low, slot, h)
    low = low.reshape(len(lines), bins)
    with np.errstate(over="ignore"):
        short = np.flatnonzero((low == _HIGH).any(axis=1))
        if len(short):
            some = low[short]
            # The next bin, around the end, that is not empty.
            at = np.arange(2 * bins)
            at = np.where(np.tile(some != _HIGH, 2), at, 2 * bins)
            at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
            step = (at - np.arange(bins)).astype(np.uint64)
            low[short] = np.take_along_axis(some, at % bins, axis=1) + step * _P
        keys = np.zeros((len(lines), bands), np.uint64)
        for i in range(rows):
            keys = _mixed(keys * _P + low[:, i::rows] + np.uint64(i + 1))
        return (keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def shingles(line: str, size: int = SHINGLE) -> frozenset[str]:
    return frozenset(line[i : i + size] for i in range(max(1, len(line) - size + 1)))


def jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    """Exact Jaccard similarity of two shingle sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def hashed_sets(lines: list[str]) -> list[np.ndarray]:
    """The shingle set of every line as sorted 64-bit hashes."""
    sets = []
    for part in _by_chars(lines):
        h, owner = shingle_hashes(lines[part])
        for own in np.split(h, np.flatnonzero(np.diff(owner)) + 1):
            own.sort()
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
    return sets


def alike(x: list[str], y: list[str], similarity: float) -> list[bool]:
    """Whether pairs of lines reach the Jaccard similarity of their shingle sets."""
    out, start = [], 0
    while start < len(x):
        # As many pairs as bring about half a million characters of new lines.
        at: dict[str, int] = {}
        size, end = 0, start
        while end < len(x) and size < _SET_CHARS:
            for line in (x[end], y[end]):
                if line not in at:
                    at[line] = len(at)
                    size += len(line)
            end += 1
        sets = hashed_sets(list(at))
        for s, t in zip(x[start:end], y[start:end], strict=True):
            if s == t or len(s) < SHINGLE or len(t) < SHINGLE:  # a shorter line is a shingle of its own
                out.append(s == t)
                continue
            a, b = sets[at[s]], sets[at[t]]
            whole = np.concatenate((a, b))
            whole.sort(kind="stable")
            both = int(np.count_nonzero(whole[1:] == whole[:-1]))
            out.append(both / (len(whole) - both) >= similarity)
        start = end
    return out


def _lines(text: str | None) -> list[tuple[int, str]]:
    """Numbers and normal forms of the lines of a text that are not blank."""
    found = []
    for i, x in enumerate((text or "").lower().split("\n")):
        # Of all white space only the plain space is printable.
        if not x.isprintable() or "  " in x or x[:1] == " " or x[-1:] == " ":
            x = " ".join(x.split())
        if x:
            found.append((i, x))
    return found


def _distinct_lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    """Digests and texts of lines, about a megabyte at a time, repeats in it left out."""
    seen: dict[int, str] = {}
    size = 0
    for batch in batches:
        for text in batch["text"]:
            for _, line in _lines(text):
                h = line_id(line)
                if h not in seen:
                    seen[h] = line
                    size += len(line)
            if size >= _GROUP_CHARS:
                yield list(seen), list(seen.values())
                seen, size = {}, 0
    if seen:
        yield list(seen), list(seen.values())


def _packed(kind: str, *columns: np.ndarray) -> tuple[str, int, bytes]:
    return kind, len(columns[0]), np.stack(columns).astype(np.int64, copy=False).tobytes()


def _unpacked(blocks: Iterator[bytes], width: int) -> np.ndarray:
    """The columns of some blocks of packed entries, put together."""
    parts = [np.frombuffer(block, np.int64).reshape(width, -1) for block in blocks]
    return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.int64)


def _changes(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before; the first does."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _in_order(h: np.ndarray, own: np.ndarray, digest: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines in order, repeated ones once, and which of them are the first of their line."""
    order = np.lexsort((line, digest, own, own == NO_ID, h))
    places = np.stack((h, own, digest, line))[:, order]
    new = np.logical_or.reduce([_changes(column) for column in places])
    return places[:, new], _changes(places[0])[new]


def _read(docs: DataFrame) -> DataFrame:
    """One pass over the texts: ``(kind, n, block)``, packed entries about a megabyte of lines at a time.

    ``place``: the line with this digest stands first in this row, at this number; ``gone``: a
    row and number where a line of the same block is repeated. ``head``: a band list and its
    smallest line in the block; ``fellow``: a band list, that line and another of its lines.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, str] = {}
        rows: list[tuple[int, int, int]] = []
        digests: list[int] = []
        numbers: list[int] = []
        size = 0

        def out() -> pd.DataFrame:
            own, digest, n = np.array(rows, np.int64).reshape(-1, 3).T
            places, first = _in_order(
                np.array(digests, np.int64), np.repeat(own, n), np.repeat(digest, n), np.array(numbers, np.int64)
            )
            h = np.repeat(np.array(list(seen), np.int64), BANDS)
            k = band_keys(list(seen.values())).ravel()
            order = np.lexsort((h, k))
            k, h = k[order], h[order]
            new = _changes(k)
            a = h[new][np.cumsum(new) - 1]
            fellow = a != h
            blocks = [
                _packed("place", *places[:, first]),
                _packed("gone", *places[1:, ~first]),
                _packed("head", k[new], h[new]),
                _packed("fellow", k[fellow], a[fellow], h[fellow]),
            ]
            return pd.DataFrame([b for b in blocks if b[1]], columns=["kind", "n", "block"])

        for batch in batches:
            for own, digest, text in zip(batch["_lm_id"].tolist(), batch["_lm_text"].tolist(), batch["text"], strict=True):
                found = _lines(text)
                rows.append((own, digest, len(found)))
                for i, line in found:
                    h = line_id(line)
                    digests.append(h)
                    numbers.append(i)
                    if h not in seen:
                        seen[h] = line
                        size += len(line)
                if size >= _GROUP_CHARS or len(digests) >= _GROUP_LINES:
                    yield out()
                    seen, rows, digests, numbers, size = {}, [], [], [], 0
        yield out()

    return stored(keyed(docs, "text").mapInPandas(read, "kind string, n long, block binary"), "line-blocks")


def _rows(blocks: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The entries of a kind as rows of long columns."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["block"]:
                yield pd.DataFrame(dict(zip(columns, _unpacked([block], len(columns)), strict=True)))

    mine = blocks.where(F.col("kind") == kind).select("block")
    return mine.mapInPandas(unpack, ", ".join(f"{c} long" for c in columns))


def _dealt(blocks: DataFrame, kind: str, width: int) -> DataFrame:
    """``(part, block)``: the entries of a kind, those with one first column in one part.

    First columns are hashes. Parts are even ranges of them, as many as give each about
    ``_PART`` entries, so a part does not grow with the input.
    """
    mine = blocks.where(F.col("kind") == kind)
    parts = (mine.agg(F.sum("n")).first()[0] or 0) // _PART + 1

    def out(held: list[bytes]) -> pd.DataFrame:
        entries = _unpacked(held, width)
        part = ((entries[0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=parts))
        cuts = np.split(entries[:, order], ends[:-1], axis=1)
        found = [(i, x.tobytes()) for i, x in enumerate(cuts) if x.shape[1]]
        return pd.DataFrame(found, columns=["part", "block"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        n = 0
        for batch in batches:
            for block, entries in zip(batch["block"], batch["n"], strict=True):
                held.append(block)
                n += entries
                if n >= _DEAL:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return mine.select("n", "block").mapInPandas(deal, "part long, block binary")


def _listed(blocks: DataFrame, pick, schema: str) -> DataFrame:
    """``pick(k, a)`` over the heads of band lists that have several, part by part.

    Heads come in order of list and line, each once. A list has one head a block at most, so
    that no part holds a long list.
    """

    def several(part: pd.DataFrame) -> pd.DataFrame:
        k, a = _unpacked(part["block"], 2)
        order = np.argsort(k)
        k, a = k[order], a[order]
        same = k[1:] == k[:-1]
        met = np.zeros(len(k), bool)
        met[1:] |= same
        met[:-1] |= same
        k, a = k[met], a[met]
        order = np.lexsort((a, k))
        k, a = k[order], a[order]
        # A repeated head goes, then a list if one head is left.
        new = _changes(k) | _changes(a)
        k, a = k[new], a[new]
        first = _changes(k)
        met = ~first
        met[:-1] |= ~first[1:]
        return pick(k[met], a[met])

    return _dealt(blocks, "head", 2).groupBy("part").applyInPandas(several, schema)


def _posts(blocks: DataFrame) -> DataFrame:
    """``(k, a, b)``: line ``b`` of band list ``k``, and a smaller line ``a`` of it."""

    def led(k: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        new = _changes(k)
        a = b[new][np.cumsum(new) - 1]
        return pd.DataFrame({"k": k, "a": a, "b": b})[~new]

    heads = _listed(blocks, led, "k long, a long, b long")
    return stored(heads.union(_rows(blocks, "fellow", ["k", "a", "b"])), "line-posts")


def scan(docs: DataFrame) -> DataFrame:
    """``(k, a, b)``: line ``b`` is a member of band list ``k``, led by line ``a``."""
    return _posts(_read(docs))


def members(scanned: DataFrame) -> DataFrame:
    """``(k, a, b)``: lists of at least two lines, each member with its leader."""
    posts = scanned.where("k IS NOT NULL").select("k", "a", "b")
    window = Window.partitionBy("k")
    heads = posts.where("a = b").select("k", "a")
    heads = heads.withColumn("lead", F.min("a").over(window)).where("a <> lead")
    heads = heads.select("k", F.col("lead").alias("a"), F.col("a").alias("b"))
    return posts.where("a <> b").union(heads).distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, text, n)`` of the wanted digests (column ``h``), ``n`` shingles: filtered in each
    task, then joined."""
    words = docs.sparkSession.sparkContext.broadcast(membership_filter(wanted, "h"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for digests, lines in _distinct_lines(batches):
            hit = np.flatnonzero(in_filter(words.value, np.array(digests, np.int64)))
            sizes = map(len, hashed_sets([lines[i] for i in hit]))
            rows = [(digests[i], lines[i], n) for i, n in zip(hit, sizes, strict=True)]
            yield pd.DataFrame(rows, columns=["h", "text", "n"]).astype({"h": "int64", "text": object, "n": "int32"})

    found = docs.select("text").mapInPandas(pick, "h long, text string, n int")
    found = found.join(wanted.select("h"), "h", "left_semi")
    return found.groupBy("h").agg(F.min("text").alias("text"), F.min("n").alias("n"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose lines reach the similarity."""

    @F.pandas_udf("boolean")
    def reach(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alike(x.tolist(), y.tolist(), similarity), dtype=bool)

    left = texts.select(F.col("h").alias("a"), F.col("text").alias("x"), F.col("n").alias("m"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("y"), "n")
    met = pairs.join(left, "a").join(right, "b")
    # Sets of too different sizes cannot be that similar.
    met = met.where(F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n"))
    return met.where(reach("x", "y")).select("a", "b")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(h, root)`` after new links: only the graph of the roots that they join is solved."""
    if roots is None:
        return stored(components(links, "line-groups").withColumnRenamed("node", "h"), "line-roots")
    a, b = (
        roots.select(F.col("h").alias(side), F.col("root").alias(f"root_{side}")) for side in ("a", "b")
    )
    ends = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    moved = components(ends, "line-groups").withColumnRenamed("root", "new")
    known = roots.union(moved.select(F.col("node").alias("h"), F.col("node").alias("root"))).distinct()
    whole = known.join(moved, known.root == moved.node, "left").select("h", F.coalesce("new", "root").alias("root"))
    return stored(whole, "line-roots")


def _fine_lists(texts: DataFrame) -> DataFrame:
    """``(k, h)`` of the finer bands of some lines, without lists of one line."""

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (batch["text"].map(len).cumsum() // _GROUP_CHARS).to_numpy()
            for _, rows in batch.groupby(part):
                k = band_keys(rows["text"].tolist(), bands=FINE_BANDS, rows=FINE_ROWS).ravel()
                h = np.repeat(rows["h"].to_numpy(), FINE_BANDS)
                order = np.lexsort((h, k))
                k, h = k[order], h[order]
                new = _changes(k)
                alone = new & np.append(new[1:], True)
                found = [_packed("head", k[new], h[new]), _packed("member", k[~alone], h[~alone])]
                yield pd.DataFrame(found, columns=["kind", "n", "block"])

    blocks = stored(texts.select("h", "text").mapInPandas(band, "kind string, n long, block binary"), "line-fine-blocks")
    heads = _listed(blocks, lambda k, h: pd.DataFrame({"k": k, "h": h}), "k long, h long")
    lists = stored(heads.union(_rows(blocks, "member", ["k", "h"])).distinct(), "line-fine")
    discard(blocks)
    return lists


def _unsettled(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``(h, root)`` of the lines in lists that hold several groups."""
    rows = lists.select("k", F.explode(F.array("a", "b")).alias("h")).distinct()
    placed = rows.join(roots, "h", "left").select("k", "h", F.coalesce("root", "h").alias("root"))
    several = placed.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top")
    return placed.join(several.select("k"), "k", "left_semi").select("h", "root").distinct()


def groups(docs: DataFrame, scanned: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(h, root)`` for lines that are near copies of another line; lines alone are left out."""
    lists = stored(members(scanned), "line-lists")
    pairs = lists.select("a", "b").distinct()
    wanted = lists.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = stored(_texts(docs, wanted), "line-texts")
    roots = _merged(None, _verified(pairs, texts, similarity))
    left = stored(_unsettled(lists, roots), "line-rest")
    discard(lists)
    fine = _fine_lists(texts.join(left, "h", "left_semi"))
    drawn = F.struct(F.xxhash64("k", "h").alias("draw"), "h")
    leads = fine.groupBy("k").agg(F.min(drawn).alias("lead"))
    led = fine.join(leads.select("k", F.col("lead.h").alias("lead")), "k").where("h <> lead")
    led = led.select(F.least("h", "lead").alias("a"), F.greatest("h", "lead").alias("b")).distinct()
    ends = [left.select(F.col("h").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    tried = led.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select("a", "b")
    links = stored(_verified(tried, texts, similarity), "line-links")
    whole = _merged(roots, links)
    for done in (fine, left, texts, links, roots):
        discard(done)
    return whole


def _places(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """``(h, row key, line)``: with a null ``h`` every place of a line but its first, and the
    first places of lines that may be among the named (a filter passes a few others)."""
    words = blocks.sparkSession.sparkContext.broadcast(membership_filter(named, "h"))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        places, first = _in_order(*_unpacked(part["block"], 4))
        wanted = ~first | in_filter(words.value, places[0])
        found = pd.DataFrame(places[:, wanted].T, columns=["h", *KEY, "line"])
        return found.assign(h=found["h"].astype("Int64").mask(~first[wanted]))

    schema = "h long, _lm_id long, _lm_text long, line long"
    return _dealt(blocks, "place", 4).groupBy("part").applyInPandas(pick, schema)


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(row key, line)`` of every line that goes.

    Of each group of equal or near lines the first stays: smallest doc_id, then text digest,
    then line number. Blank lines are no lines and never go. Repeated rows count as one row.
    """
    blocks = _read(docs)
    posts = _posts(blocks)
    named = groups(docs, posts, similarity)
    discard(posts)
    places = stored(_places(blocks, named), "line-places")
    gone = _rows(blocks, "gone", [*KEY, "line"])
    place = F.struct(F.col("_lm_id") == F.lit(NO_ID), *KEY, "line")
    tops = stored(places.join(named, "h"), "line-tops")
    firsts = tops.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    lost = joined_hot(tops, stored(firsts, "line-firsts"), "root", "n").where(place != F.col("first"))
    return gone.union(places.where("h IS NULL").select(*KEY, "line")).union(lost.select(*KEY, "line"))


def _cut(docs: DataFrame, similarity: float) -> DataFrame:
    own = [F.col(f"`{c}`") for c in docs.columns]
    gone = removals(docs, similarity).groupBy(*KEY).agg(F.collect_set("line").alias("_lm_gone"))
    return keyed(docs, F.struct(*own).alias("_lm_row")).join(gone, KEY, "left")


def _kept_text():
    """The lines whose numbers are not listed, joined again; a null text stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, gone, strict=True):
            drop = set() if numbers is None else set(numbers.tolist())
            out.append(
                None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            )
        return pd.Series(out, dtype=object)

    touched = F.col("_lm_gone").isNotNull()
    left = cut(F.when(touched, F.col("_lm_row.text")), F.col("_lm_gone"))
    return F.when(touched, left).otherwise(F.col("_lm_row.text"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the removed lines cut out of their text; all rows and columns stay."""
    return _cut(docs, similarity).select(
        *[(_kept_text() if c == "text" else F.col("_lm_row").getField(c)).alias(c) for c in docs.columns]
    )


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document ``doc_id, n_removed, text``: lines that went, and the text that is left."""
    return _cut(docs, similarity).select(
        F.col("_lm_row.doc_id").alias("doc_id"),
        F.coalesce(F.size("_lm_gone"), F.lit(0)).cast("long").alias("n_removed"),
        _kept_text().alias("text"),
    )
