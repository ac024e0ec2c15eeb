"""Exact top-k search by inner product over vector-approximation files.

Vectors are packed into blocks of ``BLOCK`` rows: one small cell number per component beside
the exact integer vectors. First only the cells are scanned: blocks of queries meet the cells
of blocks of rows, and the cells bound every inner product from both sides. A pair stays if
its upper bound reaches the k-th lower bound its task has seen, then the k-th of all. Then
exact vectors are read in the order of the bounds, first the best 2k of each query, then those
whose upper bound still reaches the k-th exact score; nothing else is read exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.llm.common import NO_ID, stored

SCALE = 64
BITS = 5
BLOCK = 4096
QUERY_BLOCK = 1024
_STEP = 256
_WAITING = 500_000  # pairs a task holds back until their bound is compared once more
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them."""
    top = float(np.abs(values).max(initial=0))
    kind = next((t for t, most in (("int8", 127), ("int16", 32767), ("int32", 2**31 - 1)) if top <= most), "float64")
    return kind, values.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(-1, dim)


def cells(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of a block of integers, and lowest integer and integers a cell of each component."""
    low = values.min(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        width = np.maximum(np.ceil((values.max(axis=0) - low + 1) / (1 << bits)), 1.0)
        at = (values - low) // width
    at = np.where(np.isfinite(at), at, 0)  # a range beyond the doubles: bounds then say nothing
    return np.minimum(at, (1 << bits) - 1).astype(np.uint8), low, width


def bounds(queries: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every inner product, from the cells alone."""
    with np.errstate(over="ignore", invalid="ignore"):
        half = (width - 1.0) / 2.0
        middle = low + cell * width + half
        size = np.abs(queries)
        rounding = 1e-9 * (size @ (np.abs(middle).max(axis=0) + width)) + 1e-9
        slack = (size @ half + rounding)[:, None]
        centre = queries @ middle.T
        lower, upper = centre - slack, centre + slack
    ends = float(_LONG[0]), -float(_LONG[0])  # scores stop at the ends of a long, and so do their bounds
    return (
        np.where(np.isnan(lower), ends[0], np.clip(lower, *ends)),
        np.where(np.isnan(upper), ends[1], np.clip(upper, *ends)),
    )


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pairwise inner products, row by row, as long; sums beyond a long stop at its ends."""
    reach = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if reach < _EXACT:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for q, r in zip(queries, rows, strict=True)]
    return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in sums], np.int64)


_BLOCKS = "block string, dim int, ids array<long>, kind string, vectors binary, cells binary, low binary, width binary"


def _blocks(vectors: DataFrame, scale: int, bits: int, size: int) -> DataFrame:
    """Rows packed into blocks; vectors that take no part are left out here."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        waiting: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            rows = waiting.pop(dim)
            values = np.array([v for _, v in rows]).reshape(len(rows), dim)
            cell, low, width = cells(values, bits)
            kind, data = _packed(values)
            return pd.DataFrame(
                [(uuid4().hex, dim, [i for i, _ in rows], kind, data, cell.tobytes(), low.tobytes(), width.tobytes())],
                columns=["block", "dim", "ids", "kind", "vectors", "cells", "low", "width"],
            )

        for batch in batches:
            for key, vector in zip(batch["vec_id"].tolist(), batch["embedding"], strict=True):
                if vector is None:
                    continue
                value = np.asarray(vector, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    value = np.floor(scale * value)
                if not len(value) or not np.isfinite(value).all():
                    continue
                rows = waiting.setdefault(len(value), [])
                rows.append((key, value))
                if len(rows) >= size:
                    yield block(len(value))
        for dim in list(waiting):
            yield block(dim)

    key = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id")
    rows = vectors.select(key, F.col("embedding").cast("array<double>"))
    return rows.mapInPandas(pack, _BLOCKS)


_QUERIES = "part string, dim int, n int, from array<string>, at array<int>, keys array<long>, queries binary"


def _queries(blocks: DataFrame, every: int, size: int) -> DataFrame:
    """Query vectors in blocks of ``size``, each vector with the block and row it comes from.

    A task numbers its own blocks of a dimension; ``part`` tells the tasks apart.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        part = uuid4().hex
        waiting: dict[int, list] = {}
        made: dict[int, int] = {}

        def block(dim: int, rows: list) -> pd.DataFrame:
            made[dim] = made.get(dim, 0) + 1
            values = np.array([v for *_, v in rows]).reshape(len(rows), dim).tobytes()
            return pd.DataFrame(
                [(part, dim, made[dim], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], values)],
                columns=["part", "dim", "n", "from", "at", "keys", "queries"],
            )

        for batch in batches:
            for _, b in batch.iterrows():
                dim = b["dim"]
                values = _unpacked(b["kind"], b["vectors"], dim)
                rows = waiting.setdefault(dim, [])
                for i in np.flatnonzero((b["ids"] != NO_ID) & (b["ids"] % every == 0)).tolist():
                    rows.append((b["block"], i, int(b["ids"][i]), values[i].copy()))
                    if len(rows) == size:
                        yield block(dim, rows)
                        rows.clear()
        for dim, rows in waiting.items():
            if rows:
                yield block(dim, rows)

    return blocks.select("block", "dim", "ids", "kind", "vectors").mapInPandas(pick, _QUERIES)


def _numbered(asked: DataFrame) -> DataFrame:
    """Query blocks numbered from 1 in each dimension, by the counts of the tasks that made them."""
    counts = asked.groupBy("dim", "part").agg(F.max("n").alias("made"))  # a row per task
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("dim", "part", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("start"))
    return asked.join(starts, ["dim", "part"]).withColumn("q", F.col("start") + F.col("n")).drop("part", "n", "start")


def _vectors(blocks: DataFrame) -> DataFrame:
    """``(block, place, vec_id, vector)``: the exact vectors one by one, as packed doubles."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.iterrows():
                values = _unpacked(b["kind"], b["vectors"], b["dim"])
                yield pd.DataFrame(
                    {"block": b["block"], "place": np.arange(len(values)), "vec_id": b["ids"], "vector": [v.tobytes() for v in values]}
                )

    wanted = blocks.select("block", "dim", "ids", "kind", "vectors")
    return wanted.mapInPandas(split, "block string, place int, vec_id long, vector binary")


def _scored(pairs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs with the exact score of their vectors; only these vectors go through the shuffle."""
    found = pairs.join(vectors, ["block", "place"]).join(asked, ["from", "at"])

    @F.pandas_udf("long")
    def score(queries: pd.Series, rows: pd.Series) -> pd.Series:
        out = np.zeros(len(rows), np.int64)
        size = rows.str.len().to_numpy()
        for length in np.unique(size):
            of = np.flatnonzero(size == length)
            left, right = (
                np.frombuffer(b"".join(side.iloc[of])).reshape(len(of), -1) for side in (queries, rows)
            )
            out[of] = exact_scores(left, right)
        return pd.Series(out)

    return found.withColumn("score", score("asked", "vector")).drop("asked", "vector")


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query.

    Vectors become ``floor(scale * x)``. Queries are the rows whose vec_id is divisible by
    ``every``; candidates all other rows of the same number of components, fewer than ``k`` if
    there are fewer. Ties go to the smaller vec_id, null last. Vectors that are null, empty or
    hold null or non-finite components take no part; a null vec_id is a candidate, never a
    query. Repeated vec_ids are rows of their own, as queries and as candidates.
    """
    packed = stored(_blocks(vectors, scale, bits, block), "vectors")
    asked = stored(_numbered(stored(_queries(packed, every, QUERY_BLOCK), "queries")), "queries")
    counts = asked.groupBy("dim").agg(F.max("q").alias("n"))
    narrow = packed.select("block", "dim", "cells", "low", "width")
    pairs = narrow.join(counts, "dim").withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    met = pairs.join(asked.select("dim", "q", "from", "at", "queries"), ["dim", "q"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best, waiting, held = None, np.zeros((0, k)), [], 0

        def sent() -> Iterator[pd.DataFrame]:
            """The waiting pairs that the k-th lower bound so far leaves possible."""
            floor = best.min(axis=1, initial=np.inf)
            for found, who in waiting:
                yield found[found["upper"].to_numpy() >= floor[who]]

        for batch in batches:
            for _, b in batch.iterrows():
                dim = b["dim"]
                cell = np.frombuffer(b["cells"], np.uint8).reshape(-1, dim)
                queries = np.frombuffer(b["queries"]).reshape(-1, dim)
                sources, at = np.asarray(b["from"]), np.asarray(b["at"], np.int64)
                low, width = np.frombuffer(b["low"]), np.frombuffer(b["width"])
                if now != (dim, b["q"]) or held > _WAITING:
                    yield from sent()
                    waiting, held = [], 0
                if now != (dim, b["q"]):  # the join brings the blocks of rows of one block of queries together
                    now, best = (dim, b["q"]), np.full((len(at), k), -np.inf)
                for start in range(0, len(queries), _STEP):
                    step = slice(start, start + _STEP)
                    lower, upper = bounds(queries[step], cell, low, width)
                    own = np.flatnonzero(sources[step] == b["block"])
                    lower[own, at[step][own]] = upper[own, at[step][own]] = -np.inf
                    top = np.partition(lower, -k, axis=1)[:, -k:] if len(cell) > k else lower
                    best[step] = np.partition(np.concatenate([best[step], top], axis=1), -k, axis=1)[:, -k:]
                    floor = best[step].min(axis=1)
                    who, place = np.nonzero((upper >= floor[:, None]) & np.isfinite(upper))
                    found = pd.DataFrame(
                        {
                            "from": sources[step][who],
                            "at": at[step][who],
                            "block": b["block"],
                            "place": place,
                            "lower": lower[who, place],
                            "upper": upper[who, place],
                        }
                    )
                    waiting.append((found, start + who))
                    held += len(who)
        yield from sent()

    bounded = met.mapInPandas(scan, "from string, at int, block string, place int, lower double, upper double")
    query = Window.partitionBy("from", "at")
    whole = query.orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = bounded.withColumn("floor", F.nth_value("lower", k).over(whole))
    live = live.where(F.col("upper") >= F.coalesce("floor", "upper"))
    order = query.orderBy(F.desc("upper"), "block", "place")
    live = stored(live.select("from", "at", "block", "place", "upper", F.row_number().over(order).alias("turn")), "bounds")

    # exact vectors in the order of their bound: the best 2k first, then what can still reach the k-th
    exact, queries = _vectors(packed), _query_vectors(asked)
    first = stored(_scored(live.where(F.col("turn") <= 2 * k), exact, queries), "scores")
    place = F.row_number().over(query.orderBy(F.desc("score")))
    certain = first.withColumn("n", place).where(F.col("n") == k).select("from", "at", F.col("score").alias("kth"))
    rest = live.where(F.col("turn") > 2 * k).join(certain, ["from", "at"], "left")
    rest = rest.where(F.col("upper") >= F.coalesce(F.col("kth").cast("double"), "upper")).drop("kth")
    found = first.unionByName(_scored(rest, exact, queries))
    found = found.withColumn("vec_id", F.when(F.col("vec_id") != F.lit(NO_ID), F.col("vec_id")))
    best = query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _query_vectors(asked: DataFrame) -> DataFrame:
    """``(from, at, query_id, asked)``: the query vectors one by one, as packed doubles."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.iterrows():
                values = np.frombuffer(b["queries"]).reshape(-1, b["dim"])
                yield pd.DataFrame(
                    {"from": b["from"], "at": b["at"], "query_id": b["keys"], "asked": [v.tobytes() for v in values]}
                )

    return asked.select("dim", "from", "at", "keys", "queries").mapInPandas(
        split, "from string, at int, query_id long, asked binary"
    )
