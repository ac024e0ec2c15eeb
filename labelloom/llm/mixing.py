"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are uniform, so their leading digits cut every
source into even ranges: word counts are summed per range, running sums over the ranges of a
source give every range its start, and inside a range the documents are sorted by key. That
is a prefix sum in which no task holds a whole source. Each source is cut at the exact word
of its budget; a budget above the source's size first takes whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.llm.common import WORD, keyed, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Hex digits of the key that name a range: 65,536 ranges a source at most.
RANGE_DIGITS = 4


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(seed: str) -> Column:
    """md5 of the seed and the id; a row without an id is keyed by its text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.md5(F.concat_ws(":", F.lit(seed), own))


def _numbered(sources: DataFrame) -> DataFrame:
    """Zero-based place of each source by code point, null last.

    Sources are numbered in ranges of two leading bytes (at most 65,536 and one for null), so
    no task holds all of them.
    """
    lead = F.when(F.col("source").isNull(), "~").otherwise(F.hex(F.substring(F.col("source").cast("binary"), 1, 2)))
    ranged = sources.withColumn("lead", lead)
    starts = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("lead", F.coalesce(F.sum("n").over(starts), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("lead").orderBy(F.col("source").cast("binary")))
    return ranged.join(before, "lead").withColumn("place", F.col("before") + within - 1).drop("lead", "before")


def targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, none above ``most`` times its size.

    Excess is shared again by weight until no target is above its limit. Each round only sums
    the capped and the free sources; there are at most as many rounds as distinct limits.
    """
    if share > most:
        raise ValueError("share must not exceed most: no mix could reach it")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    named = stored(_numbered(totals).select("source", "source_size", weight.alias("weight")), "mix-sources")
    limit = F.lit(most) * F.col("source_size")
    whole = named.agg(F.sum("source_size")).first()[0] or 0
    level, known = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) >= limit
        row = named.agg(
            F.sum(F.when(full, limit)).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == known or not row["free"]:
            break
        known = row["n"]
        level = (share * whole - (row["capped"] or 0), row["free"])
    even = limit if level is None else F.least(limit, F.col("weight") * F.lit(level[0]) / F.lit(level[1]))
    return named.select("source", "source_size", even.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Per document: row key, ``doc_id, source, size, source_size, target, epochs, taken``.

    ``epochs`` whole copies of every document of a source are taken, then the documents in
    key order up to the budget, the last of them in part, so the words taken from a source
    are the whole part of its target. A null text has size 0, null sources form one source;
    a source without words takes none. Documents with equal keys are ordered by id, size and
    text, so only repeated rows can change places. An empty table gives no rows.
    """
    base = stored(
        keyed(docs, "doc_id", "source", word_count("text").alias("size"), random_key(seed).alias("_lm_key")),
        "mix-sizes",
    ).withColumn("_lm_range", F.substring("_lm_key", 1, RANGE_DIGITS))
    goal = targets(base, weights, share, most).select(
        "source",
        "source_size",
        "target",
        F.floor("target").alias("budget"),
    )
    goal = goal.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    start = Window.partitionBy("source").orderBy("_lm_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = base.groupBy("source", "_lm_range").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("start", F.coalesce(F.sum("words").over(start), F.lit(0))).drop("words")
    named = [F.col("r.source").eqNullSafe(F.col("g.source"))]
    ranges = ranges.alias("r").join(goal.alias("g"), named).select(
        "r.source", "_lm_range", "start", "source_size", "target", "epochs", "rest"
    )
    within = (
        Window.partitionBy("source", "_lm_range")
        .orderBy("_lm_key", "_lm_id", "size", "_lm_text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = base.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p._lm_range") == F.col("r._lm_range"))
    left = F.col("rest") - F.col("start") - F.col("inside")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.alias("p").join(ranges.alias("r"), same).select(
        "_lm_id", "_lm_text", "doc_id", "p.source", "size", "source_size", "target", "epochs",
        part.alias("part"), (F.col("epochs") * F.col("size") + part).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document once per epoch taken, with ``epoch`` (from 1) added.

    The document at the border of a budget comes with its first words only. Documents without
    words cost nothing and stay once. Columns named epoch are replaced.
    """
    decided = mix(docs, **options).groupBy("_lm_id", "_lm_text").agg(
        F.first("epochs").alias("epochs"), F.max("part").alias("part"), F.first("size").alias("size")
    )
    columns = [c for c in docs.columns if c != "epoch"]
    rows = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_lm_row"))
    joined = rows.join(decided, ["_lm_id", "_lm_text"])
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 1).otherwise(copies).cast("int")
    copied = joined.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    cut = (F.col("epoch") > F.col("epochs")) & (F.col("part") < F.col("size"))
    # Words with the white space before them, as many as the part holds.
    pieces = F.regexp_extract_all(F.col("_lm_row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("part").cast("int")), "")
    out = [
        (F.when(cut, head).otherwise(F.col("_lm_row.text")) if c == "text" else F.col("_lm_row").getField(c)).alias(c)
        for c in columns
    ]
    return copied.select(*out, "epoch")
