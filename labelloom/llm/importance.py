"""Quality classifier by importance resampling of documents.

Two generative models of hashed word unigrams and bigrams are counted: one over the documents
labelled good (``quality`` = 1), one over all documents. A document's log weight is the sum
over its n-grams of the log ratio of the two models, both without the document itself. The
log weight plus a Gumbel draw of the document is its key, and the ``k`` largest keys are a
sample without replacement in proportion to the weights. ``k`` is the share of good documents
among the labelled ones, of all documents. What is not sampled is rejected.

Labels are the only bounded sample here: at most ``LABELLED`` good ids, taken in hash order,
mark their documents through a broadcast. Counts, weights and the draw cover all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import KEY, keyed, stored
from labelloom.llm.mixing import random_key

BUCKETS = 1 << 18
LABELLED = 200_000
#: Added to observed and expected counts, so rare n-grams say little.
PRIOR = 5.0
SEED = "gumbel"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(20))


def ngram_counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's unigrams and bigrams, and how often each occurs."""
    words = (text or "").encode().lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    a, b, shift = _MIX
    with np.errstate(over="ignore"):
        two = ((one[:-1] * a + one[1:]) * b) >> shift
        one = (one * a) >> shift
    return np.unique((np.concatenate((one, two)) % np.uint64(buckets)).astype(np.int64), return_counts=True)


def fit(marked: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both models by bucket, ``(all, good)``, from columns ``text`` and ``good``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_good in zip(batch["text"], batch["good"], strict=True):
                at, n = ngram_counts(text, buckets)
                every[at] += n
                if is_good:
                    good[at] += n
        at = np.flatnonzero(every)
        yield pd.DataFrame({"bucket": at, "every": every[at], "good": good[at]})

    parts = marked.mapInPandas(count, "bucket long, every long, good long")
    sums = parts.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good"))
    every, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    found = sums.toArrow()  # at most one row per bucket
    at = found["bucket"].to_numpy()
    every[at], good[at] = found["every"].to_numpy(), found["good"].to_numpy()
    return every, good


def log_weight(
    text: str | None, is_good: bool, every: np.ndarray, good: np.ndarray, share: float, prior: float = PRIOR
) -> float:
    """Sum of log ratios of a text's n-grams; the text's own counts are taken out first."""
    at, n = ngram_counts(text, len(every))
    expected = (every[at] - n) * share + prior
    observed = good[at] - (n if is_good else 0) + prior
    return float((n * np.log(observed / expected)).sum())


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The ``k``-th largest value of a column, by histograms of at most ``bins`` rows."""
    edge = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = edge["low"], edge["high"]
    while low is not None and low < high:
        width = (high - low) / bins
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        found = (
            rows.where(F.col(column).between(low, high))
            .groupBy(bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .collect()
        )
        for row in sorted(found, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
        else:
            return low
    return low


def gumbel(seed: str = SEED) -> Column:
    """A Gumbel draw per row from the md5 of seed and id (the text, where the id is null)."""
    word = F.conv(F.substring(random_key(seed), 1, 12), 16, 10).cast("double")
    return -F.log(-F.log((word + 0.5) / F.lit(float(16**12))))


def resample(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, seed: str = SEED
) -> DataFrame:
    """Per document: row key, ``doc_id, log_weight, sample_key, kept``.

    An id counts as good if all its labels say 1; null ids and null labels are no labels.
    Null and empty texts have log weight 0. Rows that tie with the last key taken are all
    kept, repeated rows among them. Without labels, or without bad ones, all rows are kept;
    an empty table gives no rows.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    judged = judged.agg(F.min("quality").alias("quality"))
    row = judged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("good")).first()
    wanted = row["good"] / row["n"] if row["n"] else 1.0
    ids = judged.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    ids = ids.select(F.col("doc_id").alias("_lm_good"))
    rows = keyed(docs, "doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_lm_good"), "left")
    rows = rows.select(*KEY, "doc_id", "text", F.col("_lm_good").isNotNull().alias("good"))
    every, good = fit(rows.select("text", "good"), buckets)
    share = float(good.sum() / max(1, every.sum()))
    model = docs.sparkSession.sparkContext.broadcast((every, good))

    @F.pandas_udf("double")
    def weigh(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, marks in batches:
            yield pd.Series(
                [log_weight(t, m, *model.value, share) for t, m in zip(texts, marks, strict=True)], dtype="float64"
            )

    weighed = rows.select(*KEY, "doc_id", weigh("text", "good").alias("log_weight"), gumbel(seed).alias("_lm_draw"))
    weighed = weighed.withColumn("sample_key", F.col("log_weight") + F.col("_lm_draw")).drop("_lm_draw")
    weighed = stored(weighed, "importance")
    k = round(wanted * weighed.count())
    border = kth_largest(weighed, "sample_key", k) if k else None
    kept = F.lit(False) if border is None else F.col("sample_key") >= F.lit(border)
    return weighed.withColumn("kept", kept)


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are sampled, all columns unchanged."""
    gone = resample(docs, labels, **options).where("NOT kept").select(*KEY).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed(docs, F.struct(*own).alias("_lm_row")).join(gone, KEY, "left_anti")
    return rows.select(*[F.col("_lm_row").getField(c).alias(c) for c in docs.columns])
