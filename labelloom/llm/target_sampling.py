"""Importance resampling of documents towards a target distribution, over distinct lines.

Features are the runs of one and of two consecutive words of a text, hashed into buckets. A
bucket's gain is the log ratio of its smoothed share in the target texts and in all documents;
a document's weight is the mean gain of its features, and weight plus a Gumbel draw is its
score. The highest scores are the sample.

Texts are cut at line ends. Each distinct line's features are counted once, whatever number of
documents holds it, and multiplied by its occurrences; so are its gains. The pairs of words
that stand across a line end are added per document.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import NO_ID, discard, doc_id, joined_hot, stored
from labelloom.operators.positions import row_position

BUCKETS = 10_000
SEED = "7"
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Percent of the other documents that are drawn.
SHARE = 25
SCALE = 1000
_CHUNK_BYTES = 1 << 20

#: Words of a text as UTF-8 in ASCII lower case: every byte that is no ASCII sign but a letter or digit.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lines_of(text: str | None) -> list[bytes]:
    """Lines with at least one word, in ASCII lower case as UTF-8."""
    return [x for x in (text or "").encode().lower().split(b"\n") if _WORD.search(x)]


def _ends(line: bytes) -> tuple[bytes, bytes]:
    return _WORD.search(line)[0], _WORD.search(line[::-1])[0][::-1]


def across(lines: list[bytes], buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word pairs that stand across the line ends of a text."""
    ends = [_ends(x) for x in lines]
    return [zlib.crc32(a[1] + b" " + b[0]) % buckets for a, b in zip(ends, ends[1:], strict=False)]


def line_features(lines: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature inside some lines, and the number of its line."""
    hashes: list[int] = []
    sizes = []
    for line in lines:
        words = _WORD.findall(line)
        one = list(map(zlib.crc32, words))
        hashes += one
        hashes += [zlib.crc32(b" " + w, c) for w, c in zip(words[1:], one, strict=False)]
        sizes.append(2 * len(words) - 1)
    return np.array(hashes, np.int64) % buckets, np.repeat(np.arange(len(lines)), sizes)


def _segments(docs: DataFrame, buckets: int) -> DataFrame:
    """Per row of the table: a number, the id, keys of its lines, buckets across them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [lines_of(t) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["lines"] = [[hashlib.md5(x).digest() for x in own] for own in lines]
            out["across"] = [across(own, buckets) for own in lines]
            yield out

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_lm_id")
    # The numbers are fixed by what is stored.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own, "text")
    return stored(
        rows.mapInPandas(cut, "row long, _lm_id long, lines array<binary>, across array<int>"), "line-keys"
    )


def _distinct_lines(docs: DataFrame) -> DataFrame:
    """``(key, line, n)``: distinct lines and their occurrences, summed in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        size = 0

        def out() -> pd.DataFrame:
            keys = [hashlib.md5(x).digest() for x in counts]
            return pd.DataFrame({"key": keys, "line": list(counts), "n": np.array(list(counts.values()), np.int64)})

        for batch in batches:
            for text in batch["text"]:
                for line in lines_of(text):
                    if line in counts:
                        counts[line] += 1
                    else:
                        counts[line] = 1
                        size += len(line)
                if size >= 4 * _CHUNK_BYTES:
                    yield out()
                    counts, size = {}, 0
        yield out()

    counted = docs.select("text").mapInPandas(count, "key binary, line binary, n long")
    return counted.groupBy("key", "line").agg(F.sum("n").alias("n"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows about a megabyte of lines at a time."""
    for batch in batches:
        part = (batch["line"].map(len).cumsum() // _CHUNK_BYTES).to_numpy()
        for _, rows in batch.groupby(part):
            yield rows


def _line_counts(lines: DataFrame, buckets: int) -> DataFrame:
    """Per distinct line its occurrences ``n`` and feature counts by bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches):
            bucket, owner = line_features(rows["line"].tolist(), buckets)
            code, n = np.unique(owner * buckets + bucket, return_counts=True)
            owner, bucket = np.divmod(code, buckets)
            edges = np.searchsorted(owner, np.arange(len(rows) + 1))
            cuts = list(zip(edges[:-1], edges[1:], strict=True))
            yield pd.DataFrame(
                {
                    "key": rows["key"].to_numpy(),
                    "n": rows["n"].to_numpy(),
                    "buckets": [bucket[i:j] for i, j in cuts],
                    "counts": [n[i:j].astype(np.int32) for i, j in cuts],
                }
            )

    schema = "key binary, n long, buckets array<int>, counts array<int>"
    return stored(lines.mapInPandas(count, schema), "line-features")


def bucket_counts(segments: DataFrame, features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of every bucket's features in all texts."""
    inside = features.select("n", F.inline(F.arrays_zip("buckets", "counts")))
    inside = inside.groupBy("buckets").agg(F.sum(F.col("n") * F.col("counts")).alias("n"))
    over = segments.select(F.explode("across").alias("buckets")).groupBy("buckets").agg(F.count(F.lit(1)).alias("n"))
    sums = inside.union(over).toArrow()  # two rows per bucket at most
    out = np.zeros(buckets, np.int64)
    np.add.at(out, sums["buckets"].to_numpy(), sums["n"].to_numpy())
    return out


def gains(every: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Per bucket the log ratio of its smoothed shares in target and all, in whole thousandths."""
    all_n, target_n, size = int(every.sum()), int(target.sum()), len(every)
    return np.array(
        [
            math.floor(scale * math.log(float(t + 1) * float(all_n + size) / (float(s + 1) * float(target_n + size))))
            for s, t in zip(every.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` its id, ``n_features`` and ``weight``; ``target`` needs column ``text``."""
    segments, lines = _segments(docs, buckets), _line_counts(_distinct_lines(docs), buckets)
    goal = target.select(F.lit(0).alias("doc_id"), "text")
    wanted = bucket_counts(_segments(goal, buckets), _line_counts(_distinct_lines(goal), buckets), buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(segments, lines, buckets), wanted))

    @F.pandas_udf("long")
    def line_gain(found: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([int((gain.value[b] * c).sum()) for b, c in zip(found, counts, strict=True)], dtype="int64")

    @F.pandas_udf("long")
    def across_gain(found: pd.Series) -> pd.Series:
        return pd.Series([int(gain.value[b].sum()) if len(b) else 0 for b in found], dtype="int64")

    features, lines = lines, lines.select(
        "key",
        "n",
        F.expr("aggregate(counts, 0L, (x, y) -> x + y)").alias("n_features"),
        line_gain("buckets", "counts").alias("gain"),
    )
    lines = stored(lines, "line-gains")
    discard(features)
    held = segments.select("row", F.explode("lines").alias("key"))
    inside = joined_hot(held, lines, "key", "n").select("row", F.lit(NO_ID).alias("_lm_id"), "n_features", "gain")
    over = segments.select("row", "_lm_id", F.size("across").cast("long"), across_gain("across"))
    # Each row of `over` holds the id; the others hold the smallest long, which no id is.
    summed = inside.union(over).groupBy("row").agg(
        F.max("_lm_id").alias("_lm_id"), F.sum("n_features").alias("n_features"), F.sum("gain").alias("gain")
    )
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return summed.select("_lm_id", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).alias("weight"))


def draw_score(seed: str = SEED, scale: int = SCALE):
    """Weight plus a Gumbel draw by the sha256 of seed and id, in whole thousandths; a null id is ''."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id().cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32)))))
    return F.col("weight") + draw.cast("long")


def sample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Per document ``doc_id, n_features, weight, score, rank``; rank is null where it is not drawn.

    ``share`` percent (rounded down) of the documents with ``least_words`` words or more are
    drawn. Null and empty texts, and texts without words, have weight 0 and are never drawn.
    Ties go to the smaller id, a null id last; repeated rows are drawn one by one. An empty
    target gives gains against even shares; an empty table gives no rows.
    """
    scored = stored(weigh(docs, target, buckets).withColumn("score", draw_score(seed)), "target-scores")
    # n words have 2 n - 1 features.
    able = F.col("n_features") >= max(1, 2 * least_words - 1)
    k = share * scored.where(able).count() // 100
    order = scored.where(able).withColumns({"_lm_low": -F.col("score"), "_lm_last": F.col("_lm_id") == F.lit(NO_ID)})
    placed = row_position(order, ["_lm_low", "_lm_last", "_lm_id"], "_lm_at")
    rank = F.when(F.col("_lm_at") < k, F.col("_lm_at") + 1)
    columns = [doc_id(), "n_features", "weight", "score"]
    drawn = placed.select(*columns, rank.cast("long").alias("rank"))
    return drawn.union(scored.where(~able).select(*columns, F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The ids of the documents that are drawn, best first by ``rank``."""
    return sample(docs, target, **options).where("rank IS NOT NULL").select("doc_id", "rank")
