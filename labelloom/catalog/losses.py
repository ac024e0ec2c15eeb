"""Loss queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import LABELS, SQL_JUDGED, judged, query, rounded, sql_order, sql_uniform, table
from labelloom.functions.labels import one_hot
from labelloom.functions.portable import uniform
from labelloom.operators.losses import (
    asymmetric_loss,
    bce_loss,
    combined_loss,
    contrastive_loss,
    label_overlap,
    single_label_loss,
)
from labelloom.operators.metrics import positive_weights
from labelloom.operators.positions import seeded_batches

SQL_WEIGHTS = """weights AS (
  SELECT 'quality' AS label, (count(*) - sum(quality)) / sum(quality) AS w FROM labels
  UNION ALL SELECT 'toxic', (count(*) - sum(toxic)) / sum(toxic) FROM labels
)"""
SQL_SIGMA = "sigma AS (SELECT label, t, 8 * s - 4 AS x, 1 / (1 + exp(-(8 * s - 4))) AS p FROM cells)"
SQL_ASYMMETRIC = """-({w} t * ln(greatest(p, 1e-8::DOUBLE)) + (1 - t) * ln(greatest(least(1 - p + 0.05, 1), 1e-8::DOUBLE)))
  * pow(1 - p * t - least(1 - p + 0.05, 1) * (1 - t), 1 * t + 4 * (1 - t))"""


@query(
    "plain_bce",
    f"""WITH {SQL_JUDGED}, {SQL_SIGMA}
        SELECT round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS bce FROM sigma""",
)
def plain_bce(spark: SparkSession, d: str) -> DataFrame:
    return bce_loss(judged(spark, d), LABELS).select(rounded("bce").alias("bce"))


@query(
    "weighted_bce",
    f"""WITH {SQL_JUDGED}, {SQL_SIGMA}, {SQL_WEIGHTS}
        SELECT round(avg(-(w * t * ln(p) + (1 - t) * ln(1 - p))), 6) AS bce FROM sigma JOIN weights USING (label)""",
)
def weighted_bce(spark: SparkSession, d: str) -> DataFrame:
    weights = positive_weights(table(spark, d, "labels"), LABELS)
    return bce_loss(judged(spark, d), LABELS, weights).select(rounded("bce").alias("bce"))


@query(
    "asymmetric_loss",
    f"""WITH {SQL_JUDGED}, {SQL_SIGMA}
        SELECT round(sum({SQL_ASYMMETRIC.format(w='')}), 6) AS asymmetric_loss FROM sigma""",
)
def asymmetric(spark: SparkSession, d: str) -> DataFrame:
    return asymmetric_loss(judged(spark, d), LABELS).select(rounded("asymmetric_loss").alias("asymmetric_loss"))


@query(
    "asymmetric_loss_weighted",
    f"""WITH {SQL_JUDGED}, {SQL_SIGMA}, {SQL_WEIGHTS}
        SELECT round(sum({SQL_ASYMMETRIC.format(w='w *')}), 6) AS asymmetric_loss
        FROM sigma JOIN weights USING (label)""",
)
def asymmetric_weighted(spark: SparkSession, d: str) -> DataFrame:
    weights = positive_weights(table(spark, d, "labels"), LABELS)
    loss = asymmetric_loss(judged(spark, d), LABELS, weights=weights)
    return loss.select(rounded("asymmetric_loss").alias("asymmetric_loss"))


SQL_SINGLE = """WITH cells AS (
    SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS pos FROM embeddings
  ), logs AS (
    SELECT *, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id)) AS lp FROM cells
  ), focused AS (
    SELECT vec_id, CASE WHEN pos = label THEN 1.0 ELSE 0.0 END::DOUBLE AS t, lp FROM logs
  ), per_row AS (
    SELECT vec_id, -sum((t * 0.9 + 0.1 / 64) * lp * pow(1 - exp(lp) * t - (1 - exp(lp)) * (1 - t), 4 * (1 - t))) AS loss
    FROM focused GROUP BY vec_id
  )"""


@query("asl_single_label", f"{SQL_SINGLE} SELECT round(avg(loss), 6) AS single_label_loss FROM per_row")
def single_label(spark: SparkSession, d: str) -> DataFrame:
    loss = single_label_loss(table(spark, d, "embeddings"), "embedding", "label", 64)
    return loss.select(rounded("single_label_loss").alias("single_label_loss"))


@query("asl_single_label_rows", f"{SQL_SINGLE} SELECT vec_id, round(loss, 6) AS single_label_loss FROM per_row")
def single_label_rows(spark: SparkSession, d: str) -> DataFrame:
    loss = single_label_loss(table(spark, d, "embeddings"), "embedding", "label", 64, reduction="none")
    return loss.select("vec_id", rounded("single_label_loss").alias("single_label_loss"))


@query(
    "label_overlap",
    f"""WITH b AS (SELECT *, (row_number() OVER (ORDER BY {sql_order('2:0', 'doc_id')}) - 1) // 24 AS batch FROM labels)
        SELECT a.doc_id, a.batch, coalesce(sum(a.quality * c.quality + a.toxic * c.toxic), 0)::BIGINT AS overlap
        FROM b a LEFT JOIN b c ON a.batch = c.batch AND a.doc_id <> c.doc_id GROUP BY a.doc_id, a.batch""",
)
def overlap(spark: SparkSession, d: str) -> DataFrame:
    batched = seeded_batches(table(spark, d, "labels"), ["doc_id"], 2)
    return label_overlap(batched, LABELS).select("doc_id", "batch", "overlap")


SQL_PAIRS = f"""rows AS (
    SELECT vec_id, label, (row_number() OVER (ORDER BY {sql_order('2:0', 'vec_id')}) - 1) // 24 AS batch,
           list_transform(embedding::DOUBLE[],
             lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
    FROM embeddings
  ), pairs AS (
    SELECT a.batch, a.vec_id, (a.label = b.label)::INTEGER AS shared, list_distance(a.u, b.u) / 0.1 AS z
    FROM rows a JOIN rows b ON a.batch = b.batch AND a.vec_id <> b.vec_id
  ), anchors AS (
    SELECT batch, vec_id, 1e-12 + sum(shared) AS c, 1e-12 + sum(exp(-z)) AS e FROM pairs GROUP BY batch, vec_id
  ), per_row AS (
    SELECT p.batch, p.vec_id, sum(-(shared / c) * (-z - ln(e))) AS l
    FROM pairs p JOIN anchors USING (batch, vec_id) GROUP BY p.batch, p.vec_id
  ), sizes AS (SELECT batch, count(*) AS n FROM rows GROUP BY batch)"""


def batched_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumn("labels", one_hot(F.col("label"), 10))
    return seeded_batches(vectors, ["vec_id"], 2)


@query(
    "contrastive_loss",
    f"""WITH {SQL_PAIRS}
        SELECT batch, round(sum(l) / any_value(n), 6) AS contrastive FROM per_row JOIN sizes USING (batch) GROUP BY batch""",
)
def contrastive(spark: SparkSession, d: str) -> DataFrame:
    loss = contrastive_loss(batched_vectors(spark, d), row_id="vec_id")
    return loss.select("batch", rounded("contrastive").alias("contrastive"))


@query(
    "contrastive_loss_first",
    f"""WITH {SQL_PAIRS}
        SELECT batch, round(l / n, 6) AS contrastive FROM per_row JOIN sizes USING (batch)
        QUALIFY row_number() OVER (PARTITION BY batch ORDER BY vec_id) = 1""",
)
def contrastive_first(spark: SparkSession, d: str) -> DataFrame:
    loss = contrastive_loss(batched_vectors(spark, d), row_id="vec_id", anchor="first")
    return loss.select("batch", rounded("contrastive").alias("contrastive"))


@query(
    "combined_loss",
    f"""WITH {SQL_PAIRS}, logits AS (
          SELECT batch, (pos = label)::INTEGER AS y, 1 / (1 + exp(-(8 * {sql_uniform('logit', 'vec_id', 'pos')} - 4))) AS p
          FROM rows, range(0, 10) AS r(pos)
        ), b AS (SELECT batch, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS bce FROM logits GROUP BY batch),
        c AS (SELECT batch, sum(l) / any_value(n) AS contrastive FROM per_row JOIN sizes USING (batch) GROUP BY batch)
        SELECT batch, round(bce + 0.1 * contrastive, 6) AS loss FROM b JOIN c USING (batch)""",
)
def combined(spark: SparkSession, d: str) -> DataFrame:
    rows = batched_vectors(spark, d)
    names = [f"class{i}" for i in range(10)]
    cells = rows.select(
        "batch",
        *[(8.0 * uniform("logit", F.col("vec_id"), F.lit(i)) - 4.0).alias(f"x_{n}") for i, n in enumerate(names)],
        *[F.get("labels", F.lit(i)).alias(f"t_{n}") for i, n in enumerate(names)],
    )
    both = combined_loss(bce_loss(cells, names, group=["batch"]), contrastive_loss(rows, row_id="vec_id"))
    return both.select("batch", rounded("loss").alias("loss"))
