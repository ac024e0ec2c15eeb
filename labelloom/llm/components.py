"""Connected components as a distributed union-find: large-star and small-star rounds.

Each round only groups and joins edges; a node's neighbours are never gathered in one place.
Before a round, every task replaces the edges it reads by stars around the smallest node of
each group they form, so a node enters the round with one edge a task to smaller nodes, and
copies of an edge go. Rounds end when all edges together are such stars, which one grouping of
the nodes tells and which takes O(log n) rounds in practice; what comes in is mostly stars
already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.llm.common import discard, stored

_EDGES = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges but the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(x):
        # Roots take the smallest root beside them; then every node is led to its root.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with ``a > b`` that join the same nodes: stars, for about ``_EDGES`` edges of a task."""

    def out(held: list[pd.DataFrame]) -> pd.DataFrame:
        a, b = stars(*(np.concatenate([part[c].to_numpy() for part in held]) for c in ("a", "b")))
        return pd.DataFrame({"a": a, "b": b})

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= _EDGES:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return edges.mapInPandas(contract, "a long, b long")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over contracted edges.

    An edge moves to the smallest neighbour of its smaller node, if that node has smaller ones;
    then a node's smaller neighbours join the smallest of them. Those are one a task at most.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    # An edge to the smallest neighbour stays, any other leads from that neighbour to it.
    return small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether edges with ``a > b`` are stars: a node has one smaller neighbour or larger ones."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1 AND up > 0").limit(1).count() == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node with an edge; root is the smallest node it reaches.

    ``edges`` has long columns ``a`` and ``b`` in any order; loops and repeats do no harm,
    nulls are ignored. No edges give no rows.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    while True:
        joined = stored(_contracted(now), name)
        discard(now)
        if _settled(joined):
            break
        now = stored(_round(joined), name)
        discard(joined)
    nodes = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
