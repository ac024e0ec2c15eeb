"""Registration of queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.functions.portable import uniform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *keys: str) -> DataFrame:
    """The keys and texts of a table; how it is split is left to the session's read settings."""
    return table(spark, folder, name).select(*keys, "text")


def sql_uniform(seed: str, *keys: str) -> str:
    """SQL of :func:`labelloom.functions.portable.uniform`; keys are SQL expressions."""
    joined = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def sql_order(seed: str, key: str) -> str:
    """SQL of :func:`labelloom.operators.positions.order_key` for one key."""
    return f"(md5(concat_ws(':', '{seed}', {key})) || ':' || {key}::VARCHAR)"


LABELS = ["quality", "toxic"]


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with rule predictions, scores and logits beside the truth."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    truth = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("t_quality"), F.col("toxic").alias("t_toxic")
    )
    score = {n: uniform(n, "doc_id") for n in LABELS}
    return truth.join(docs, "doc_id").withColumns(
        {
            "p_quality": (F.col("n_chars") >= 500).cast("int"),
            "p_toxic": (F.col("lang") != "en").cast("int"),
            **{f"s_{n}": s for n, s in score.items()},
            **{f"x_{n}": F.lit(8.0) * s - F.lit(4.0) for n, s in score.items()},
        }
    )


SQL_JUDGED = f"""judged AS (
  SELECT doc_id, quality AS t_quality, toxic AS t_toxic, lang, n_chars,
         (n_chars >= 500)::INTEGER AS p_quality, (lang <> 'en')::INTEGER AS p_toxic,
         {sql_uniform('quality', 'doc_id')} AS s_quality,
         {sql_uniform('toxic', 'doc_id')} AS s_toxic
  FROM labels JOIN documents USING (doc_id)
), cells AS (
  SELECT doc_id, 'quality' AS label, t_quality AS t, p_quality AS p, s_quality AS s FROM judged
  UNION ALL
  SELECT doc_id, 'toxic', t_toxic, p_toxic, s_toxic FROM judged
)"""


def fold_predictions(spark: SparkSession, folder: str, folds: int = 6) -> DataFrame:
    """0/1 predictions of six folds for every document, as one stacked table."""
    docs = table(spark, folder, "documents").select("doc_id")
    folded = docs.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return folded.select(
        "fold",
        "doc_id",
        *[(uniform(n, "fold", "doc_id") < 0.5).cast("int").alias(n) for n in LABELS],
    )


SQL_FOLDED = f"""folded AS (
  SELECT fold, doc_id,
         ({sql_uniform('quality', 'fold', 'doc_id')} < 0.5)::INTEGER AS quality,
         ({sql_uniform('toxic', 'fold', 'doc_id')} < 0.5)::INTEGER AS toxic
  FROM documents, range(1, 7) AS f(fold)
)"""


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)
