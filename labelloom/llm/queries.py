"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import (
    alignment,
    fm_index,
    importance,
    lbl,
    lines,
    mixing,
    sanitise,
    secret_scan,
    simhash,
    suffix_dedup,
    target_sampling,
    token_counts,
    va_file,
)
from labelloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_importance(spark: SparkSession, folder: str) -> DataFrame:
    sampled = importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return sampled.select("doc_id", "log_weight", "sample_key", "kept")


def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"), length=200)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, bits=2)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_va_file(spark: SparkSession, folder: str) -> DataFrame:
    return va_file.top_k(table(spark, folder, "embeddings"), k=20, every=20, scale=64)


def op7_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.report(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, folder, "documents"), str(model), limit=4096)


def op9_lbl(spark: SparkSession, folder: str) -> DataFrame:
    return lbl.scores(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = fm_index.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.measured(table(spark, folder, "documents"), *paths)


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


def op13_target_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_sampling.sample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_importance": op2_importance,
    "op3_lines": op3_lines,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_va_file": op6_va_file,
    "op7_sanitise": op7_sanitise,
    "op8_token_counts": op8_token_counts,
    "op9_lbl": op9_lbl,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_secrets": op12_secrets,
    "op13_target_sampling": op13_target_sampling,
}

_WORDS = r"[^\x20\x09-\x0D]+"

SQL_MIXING = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))))) AS k
  FROM documents
), named AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source)
), ranked AS (
  SELECT *, sum(source_size) OVER () AS whole,
         coalesce(sum(2 * source_size) OVER f, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS free,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place
  FROM named WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT 1.5::DOUBLE * whole - capped AS up, free FROM ranked
  WHERE w * (1.5::DOUBLE * whole - capped) / free < 2 * source_size ORDER BY place LIMIT 1
), goal AS (
  SELECT source, source_size,
         least(2 * source_size, w * (SELECT up FROM level) / (SELECT free FROM level))::DOUBLE AS target FROM named
), budget AS (
  SELECT *, floor(target)::BIGINT AS b,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goal
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, b - epochs * source_size - before)))::BIGINT AS taken
FROM placed p JOIN budget g ON p.source IS NOT DISTINCT FROM g.source
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL_DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({_ASCII_LOWER.format('text')}, '{_ALNUM}'), []) AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER.format('text')}, '{_ALNUM}') AS ws FROM benchmark
  WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM b, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS t(i) WHERE len(ws) > 0
), lengths AS (
  SELECT DISTINCT n FROM windows
), cuts AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM d, lengths, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n
), hits AS (
  SELECT r, cuts.n, i, item_id FROM cuts JOIN windows USING (n, w)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

SQL: dict[str, str] = {
    "op1_mixing": SQL_MIXING,
    "op10_decontamination": SQL_DECONTAMINATION,
}
