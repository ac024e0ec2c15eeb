"""SimHash near-duplicates through an inverted index on positional bytes.

A 64-bit fingerprint is 8 bytes at 8 positions. Two fingerprints with at most ``d`` differing
bits differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes. Cut
into ``d + 2`` runs of positions, at least two whole runs agree. The index therefore posts
every fingerprint under the bytes of each two runs (for d = 2 four bytes, six postings): a
posting list on one single byte would hold 1/256 of all documents and its pairs would grow
with their square. Pairs that meet in a list are tallied: shared positional bytes, at least
``8 - d`` of them; pairs that pass are verified bit by bit.

Lists longer than ``list_limit`` hold many texts near one another. Their pairs are never
formed. Instead each member posts itself and its one-bit neighbours; two fingerprints within
two bits always share such a posting, and any two that share one are within two bits, so
linking all members of a posting to its smallest is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import KEY, keyed, stored
from labelloom.llm.components import components

SEED = 42
LIST_LIMIT = 64
_CHUNK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, in the order of ``unpackbits``."""
    bits = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    part = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # bytes stay below 256
    return part.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text; without words it is zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        counts = bit_counts(np.array([digest(joined, SEED)], np.uint64))
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        counts = np.zeros(64, np.int64)
        for at in range(0, n, _CHUNK):
            to = min(n, at + _CHUNK)
            spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
            hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, to - at)
            counts += bit_counts(hashes)
    return int(np.packbits(2 * counts > n).view(np.int64)[0])


def fingerprint_column(text: Column | str, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return fold(text)


def _runs(bits: int) -> list[int]:
    """Masks of the runs of byte positions."""
    masks = []
    for part in np.array_split(np.arange(8), bits + 2):
        masks.append(sum(0xFF << (8 * int(p)) for p in part))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, bits: int = 2, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(a, b)`` links among distinct fingerprints, column ``fp``; enough to connect every
    two within ``bits`` differing bits, and none between others."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    masks = [_signed(x | y) for x, y in combinations(_runs(bits), 2)]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"), F.lit(m).alias("mask"))
                for i, m in enumerate(masks)
            ]
        )
    )
    posts = prints.select("fp", rows.alias("r")).select("fp", "r.*")
    sizes = posts.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = stored(posts.join(sizes, ["p", "k"]), "simhash-lists")
    short = posts.where(F.col("n") <= list_limit).select("p", "k", F.col("fp").alias("a"))
    other = short.select("p", "k", F.col("a").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(
        F.when(differ.bitwiseAND(F.lit(_signed(0xFF << (8 * i)))) == 0, 1).otherwise(0) for i in range(8)
    )
    met = short.join(
        other,
        (short.p == other.p) & (short.k == other.k) & (F.col("a") < F.col("b")) & (tally >= 8 - bits)
        & (F.bit_count(differ) <= bits),
    ).select("a", "b")
    if not bits:
        return met
    flips = F.filter(
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)]),
        lambda flip: flip.bitwiseAND(F.col("mask")) == 0,
    )
    near = posts.where(F.col("n") > list_limit).select("fp", "mask", F.explode(flips).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v")).distinct()
    if bits == 2:
        centre = near.groupBy("v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    else:  # a one-bit posting counts only where it is itself a fingerprint
        centre = near.where("fp = v").select("v", F.col("v").alias("b"))
    starred = near.join(centre, "v").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return met.union(starred)


def _classes(prints: DataFrame, bits: int, list_limit: int) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of a stored table."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, bits, list_limit), "simhash")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Per document: ``doc_id``, ``fp`` (signed), ``component_id`` (smallest reachable doc_id).

    Documents without words all have fingerprint zero and are linked like any others. A null
    doc_id never names a component unless all its members are null. Repeated rows come back
    as often as they went in. An empty table gives no rows.
    """
    prints = stored(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp")), "simhash-prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = firsts.join(_classes(prints, bits, list_limit), "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """The documents, one of each group: the smallest doc_id (null last), then text digest.

    All columns are kept. Of repeated rows one stays.
    """
    prints = stored(keyed(docs, fingerprint_column("text", shingle).alias("fp")), "simhash-prints")
    order = F.struct(F.col("_lm_id") == F.lit(-(1 << 63)), *KEY)
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    best = firsts.join(_classes(prints, bits, LIST_LIMIT), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = best.select(*[F.col(f"first.{k}").alias(k) for k in KEY])
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed(docs, F.struct(*own).alias("_lm_row")).join(keep, KEY)
    # Repeated rows lie in one partition already; one of each is taken.
    return rows.dropDuplicates(KEY).select(*[F.col("_lm_row").getField(c).alias(c) for c in docs.columns])
