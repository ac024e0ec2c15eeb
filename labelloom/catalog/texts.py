"""Text queries: templates, tokens, padding, swaps, augmentation, encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import query, rounded, sql_uniform, table, texts
from labelloom.functions.text import (
    attention_mask,
    pad_tokens,
    split_words,
    swap_adjacent,
    swap_rounds,
    word_tokens,
)
from labelloom.operators.augment import augment
from labelloom.operators.columns import with_stance_prefix
from labelloom.operators.inference import model_encoder

def turn_id() -> Column:
    return F.concat_ws("-", F.col("conv_id"), F.col("turn"))


@query(
    "stance_prefix",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'I disagree that ' ELSE 'I agree that ' END
              || source || ', because ' || text AS "Premise" FROM documents""",
)
def stance_prefix(spark: SparkSession, d: str) -> DataFrame:
    arguments = table(spark, d, "documents").select(
        "doc_id",
        F.col("source").alias("Conclusion"),
        F.when(F.col("lang") == "en", "against").otherwise("in favor of").alias("Stance"),
        F.col("text").alias("Premise"),
    )
    return with_stance_prefix(arguments).select("doc_id", "Premise")


@query(
    "tokenize_words",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM documents)
        SELECT doc_id, len(words)::INTEGER AS words, md5(array_to_string(words, ' ')) AS digest FROM t""",
)
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    words = texts(spark, d, "documents", "doc_id").select("doc_id", word_tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(
    "pad_tokens",
    r"""WITH t AS (
          SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'),
                 lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT) AS ids FROM conversations)
        SELECT conv_id, turn, array_to_string(list_resize(ids, 256, 0), ' ') AS input_ids,
               array_to_string(list_transform(range(1, 257), lambda i: (i <= len(ids))::INTEGER), '') AS mask FROM t""",
)
def padded(spark: SparkSession, d: str) -> DataFrame:
    words = word_tokens(F.col("text"))
    ids = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))
    turns = texts(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", ids.alias("ids"))
    return turns.select(
        "conv_id",
        "turn",
        F.array_join(pad_tokens(F.col("ids")), " ").alias("input_ids"),
        F.array_join(attention_mask(F.col("ids")), "").alias("mask"),
    )


def sql_swapped(words: str, seed: str, *keys: str) -> str:
    place = f"(floor({sql_uniform(seed, *keys, 'r')} * (len({words}) - 1)) + 1)::INTEGER::VARCHAR"
    rounds = f"greatest(1, least(10, floor(len({words}) * 0.3)))::INTEGER"
    return f"""CASE WHEN len({words}) < 2 THEN {words} ELSE list_reduce(
        [{words}] || list_transform(range(1, {rounds} + 1), lambda r: [{place}]),
        lambda acc, x: acc[1:x[1]::INTEGER - 1] || [acc[x[1]::INTEGER + 1]] || [acc[x[1]::INTEGER]]
                       || acc[x[1]::INTEGER + 2:]) END"""


SQL_TURNS = r"""turns AS (
  SELECT conv_id || '-' || turn AS id, text,
         list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM conversations
)"""


@query(
    "swap_words",
    f"""WITH {SQL_TURNS}
        SELECT id, array_to_string({sql_swapped('words', '2', 'id')}, ' ') AS text FROM turns""",
)
def swap_words(spark: SparkSession, d: str) -> DataFrame:
    turns = texts(spark, d, "conversations", "conv_id", "turn").select(turn_id().alias("id"), split_words(F.col("text")).alias("words"))
    swapped = swap_adjacent(F.col("words"), swap_rounds(F.col("words")), 2, "id")
    return turns.select("id", F.array_join(swapped, " ").alias("text"))


@query(
    "augment_rate",
    f"""WITH {SQL_TURNS}, copies AS (
          SELECT id, text, words, k FROM turns, range(-1, 4) AS copy(k)
          WHERE k < 3 OR {sql_uniform('2:rest', 'id')} < 3.6::DOUBLE - 3)
        SELECT CASE WHEN k < 0 THEN id ELSE id || '_aug' || k END AS id,
               CASE WHEN k < 0 THEN text ELSE array_to_string({sql_swapped('words', '2', 'id', 'k')}, ' ') END AS text
        FROM copies""",
)
def augment_rate(spark: SparkSession, d: str) -> DataFrame:
    turns = texts(spark, d, "conversations", "conv_id", "turn").select(turn_id().alias("id"), "text")
    return augment(turns, 3.6, "id", "text")


def letter_shares():
    """A tiny text model: length and share of some letters."""
    import numpy as np

    def predict(texts):
        flat = [t for t in np.asarray(texts).reshape(-1)]
        return np.array([[len(t), *[t.count(c) / len(t) for c in "aeiou"]] for t in flat], dtype="float32")

    return predict


@query(
    "encode_texts",
    """WITH v AS (SELECT doc_id, [length(text)::DOUBLE] || list_transform(['a','e','i','o','u'],
                  lambda c: (length(text) - length(replace(text, c, ''))) / length(text)) AS x FROM documents)
       SELECT doc_id, unnest(range(0, 6))::INTEGER AS pos, round(unnest(x)::FLOAT::DOUBLE, 6) AS x FROM v""",
)
def encode_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents", "doc_id")
    encoded = model_encoder(letter_shares)(docs, "text", "embedding")
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return cells.withColumn("x", rounded(F.col("x").cast("double")))
