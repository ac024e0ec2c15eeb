"""Fold, order, batch and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import query, rounded, sql_order, sql_uniform, table
from labelloom.functions.portable import uniform
from labelloom.operators.augment import sample_rows
from labelloom.operators.folds import assign_folds, fold_splits, group_leakage
from labelloom.operators.losses import epoch_loss
from labelloom.operators.positions import batch_of, row_position, seeded_batches
from labelloom.operators.selection import best_epoch

SQL_FOLDS = f"""SELECT doc_id, (ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}))::INTEGER AS fold FROM labels"""


@query("kfold_assign", SQL_FOLDS)
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return assign_folds(table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query(
    "kfold_hashed",
    f"SELECT doc_id, (floor({sql_uniform('2', 'doc_id')} * 6) + 1)::INTEGER AS fold FROM documents",
)
def kfold_hashed(spark: SparkSession, d: str) -> DataFrame:
    return assign_folds(table(spark, d, "documents").select("doc_id"), ["doc_id"], exact=False)


@query(
    "kfold_grouped",
    f"SELECT doc_id, source, (floor({sql_uniform('2', 'source')} * 6) + 1)::INTEGER AS fold FROM documents",
)
def kfold_grouped(spark: SparkSession, d: str) -> DataFrame:
    return assign_folds(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], group="source")


@query(
    "group_leakage",
    f"""WITH f AS (SELECT source, ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS fold FROM documents)
        SELECT source, count(*) AS rows, min(fold)::INTEGER AS first_fold, max(fold)::INTEGER AS last_fold
        FROM f GROUP BY source HAVING min(fold) <> max(fold)""",
)
def leakage(spark: SparkSession, d: str) -> DataFrame:
    held = assign_folds(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"])
    return group_leakage(held, "source")


@query(
    "fold_splits",
    f"""WITH f AS ({SQL_FOLDS})
        SELECT doc_id, k::INTEGER AS fold, CASE WHEN fold = k THEN 'valid' ELSE 'train' END AS split
        FROM f, range(1, 7) AS r(k)""",
)
def splits(spark: SparkSession, d: str) -> DataFrame:
    return fold_splits(assign_folds(table(spark, d, "labels").select("doc_id"), ["doc_id"]))


@query(
    "shuffle_batches",
    f"""SELECT doc_id, (row_number() OVER (ORDER BY {sql_order('2:0', 'doc_id')}) - 1) // 24 AS batch FROM labels""",
)
def shuffle_batches(spark: SparkSession, d: str) -> DataFrame:
    return seeded_batches(table(spark, d, "labels").select("doc_id"), ["doc_id"], 2)


@query(
    "batch_assign",
    "SELECT doc_id, row_pos, row_pos // 24 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_pos FROM documents)",
)
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return batch_of(row_position(table(spark, d, "documents").select("doc_id"), ["doc_id"]), "row_pos")


@query("sample_rate", f"SELECT doc_id FROM documents WHERE {sql_uniform('sample', 'doc_id')} < 0.6")
def sample_rate(spark: SparkSession, d: str) -> DataFrame:
    return sample_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.6, "sample")


@query(
    "epoch_loss",
    f"""SELECT turn, round(avg({sql_uniform('loss', 'conv_id', 'turn')}), 6) AS train_loss, count(*) AS batches
        FROM conversations GROUP BY turn""",
)
def losses_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "conversations").select("turn", uniform("loss", "conv_id", "turn").alias("loss"))
    return epoch_loss(log, "turn").withColumn("train_loss", rounded("train_loss"))


# A run per conversation, an epoch per turn; with this patience some runs stop early.
RUN_PATIENCE = 2
RUN_EPOCHS = "(SELECT max(turn) + 1 FROM conversations)"

SQL_BEST = f"""
WITH RECURSIVE logged AS (
  SELECT conv_id, turn::INTEGER AS e, round({sql_uniform('f1', 'conv_id', 'turn')}, 6) AS s,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, 0.0::DOUBLE AS best, NULL::INTEGER AS best_at, 0 AS waited, NULL::INTEGER AS stop
  FROM (SELECT DISTINCT conv_id FROM logged)
  UNION ALL
  SELECT w.conv_id, l.n,
         CASE WHEN l.s - w.best > 0.0002 THEN l.s ELSE w.best END,
         CASE WHEN l.s - w.best > 0.0002 THEN l.e ELSE w.best_at END,
         CASE WHEN l.s - w.best > 0.0002 THEN 0 ELSE w.waited + 1 END,
         CASE WHEN l.s - w.best <= 0.0002 AND w.waited + 1 >= {RUN_PATIENCE} AND l.e > {RUN_EPOCHS} // 2 THEN l.e END
  FROM walk w JOIN logged l ON l.conv_id = w.conv_id AND l.n = w.n + 1
  WHERE w.stop IS NULL
)
SELECT conv_id, best_at AS best_epoch, best AS best_f1, stop AS stop_epoch
FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
"""


@query("best_epoch", SQL_BEST)
def best(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "conversations").select(
        "conv_id", "turn", F.round(uniform("f1", "conv_id", "turn"), 6).alias("f1")
    )
    epochs = log.agg(F.max("turn")).first()[0]
    return best_epoch(log, (epochs or 0) + 1, "conv_id", "turn", "f1", patience=RUN_PATIENCE)
