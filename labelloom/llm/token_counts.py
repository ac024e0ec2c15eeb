"""Token counts of whole texts by two map-side tiers; no pre-token is ever shuffled.

The tokenizer is sentencepiece BPE with byte fallback, identity normaliser, and a space put
before the text. No piece holds a space after another character, and none holds a line end,
so nothing merges across the start of a run of spaces or a line end: a text falls apart into
pre-tokens whose token counts add up.

First tier: the lengths of frequent pre-tokens, broadcast. All texts are counted; a task sends
its ``TASK_TOP`` most frequent pre-tokens, and of their sums the ``TABLE_ROWS`` largest make
the table. The table only saves time and never changes a count. Its size is bounded by
``TABLE_ROWS`` entries of at most ``MOST_CHARS`` characters.
Second tier: what is not in the table is encoded once per task and kept in a cache, which
starts again when it holds ``CACHE_ROWS`` entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TABLE_ROWS = 65_536
TASK_TOP = 8_192
MOST_CHARS = 48
CACHE_ROWS = 300_000
_PIECE_CHARS = 1 << 20
_COUNTER_ROWS = 1_000_000

PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")


def pre_tokens(text: str) -> list[str]:
    """A text cut where no piece can cross; U+2581 is the tokenizer's own sign for a space."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def _groups(texts: list[str]) -> Iterator[list[list[str]]]:
    """Pre-token lists of some texts at a time, so that memory stays bounded."""
    group, size = [], 0
    for text in texts:
        group.append(pre_tokens(text))
        size += len(text)
        if size >= _PIECE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_lengths(processor, tokens: list[str]) -> list[int]:
    """Tokens of each pre-token; the line end before it keeps the added first space apart."""
    return [len(ids) - 2 for ids in processor.encode(["\n" + t for t in tokens], num_threads=1)]


def frequent_lengths(docs: DataFrame, model: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The first tier: at most ``rows`` frequent pre-tokens with their token counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for group in _groups([t or "" for t in batch["text"]]):
                for tokens in group:
                    seen.update(tokens)
                if len(seen) > _COUNTER_ROWS:
                    seen = Counter(dict(seen.most_common(_COUNTER_ROWS // 4)))
        top = [(t, n) for t, n in seen.most_common(TASK_TOP) if n > 1 and len(t) <= MOST_CHARS]
        yield pd.DataFrame(top, columns=["token", "n"]).astype({"token": object, "n": "int64"})

    top = docs.select("text").mapInPandas(count, "token string, n long")
    ranked = top.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(rows)
    tokens = [r["token"] for r in ranked.collect()]  # at most `rows`
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    return dict(zip(tokens, encode_lengths(processor, tokens), strict=True))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, rows: int = TABLE_ROWS) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``model`` is the path of a sentencepiece model that every worker has. Null and empty texts
    have 0 bytes and 0 tokens. Every row gives one row; an empty table gives none.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, model, rows))

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        known = dict(table.value)
        for batch in batches:
            sums = []
            for group in _groups([t or "" for t in batch]):
                if len(known) > CACHE_ROWS + len(table.value):
                    known = dict(table.value)
                new = list({t for tokens in group for t in tokens if t not in known})
                known.update(zip(new, encode_lengths(processor, new), strict=True))
                sums.extend(sum(map(known.__getitem__, tokens)) for tokens in group)
            yield pd.Series(np.array(sums, np.int64))

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        lengths(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
