"""Vector, neighbour and blending queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import query, rounded, sql_order, sql_uniform, table
from labelloom.functions.labels import one_hot
from labelloom.functions.portable import uniform
from labelloom.functions.vectors import euclidean, kernel, l2_normalize, log_softmax, masked_softmax
from labelloom.operators.ensemble import threshold_columns
from labelloom.operators.cells import read_cells, write_cells
from labelloom.operators.folds import assign_folds
from labelloom.operators.inference import blended_scores, mean_vector_arrays, mean_vectors
from labelloom.operators.knn import knn_label_scores, nearest_neighbours, search_cells
from labelloom.session import new_path

CLASSES = [f"class{i}" for i in range(10)]
SQL_CELLS = "cells AS (SELECT vec_id, label, unnest(range(0, 64))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(
    "mean_vector",
    f"WITH {SQL_CELLS} SELECT label, pos, round(avg(v), 6) AS mean FROM cells GROUP BY label, pos",
)
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    return mean_vectors(table(spark, d, "embeddings"), "label").withColumn("mean", rounded("mean"))


@query(
    "pair_distance",
    f"""WITH {SQL_CELLS}, m AS (SELECT label, pos, avg(v) AS mean FROM cells GROUP BY label, pos),
        gaps AS (SELECT vec_id, sqrt(sum((v - mean) * (v - mean))) AS distance FROM cells JOIN m USING (label, pos) GROUP BY vec_id)
        SELECT vec_id, round(distance, 6) AS distance, round(exp(-distance), 6) AS kernel,
               round(exp(-distance / 0.1), 6) AS sharp FROM gaps""",
)
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    # One mean per label, looked up in a map: a join would send a label's vectors to one task.
    means = mean_vector_arrays(vectors, "label")
    by_label = means.agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("m")).scalar()
    pairs = vectors.withColumn("mean", F.try_element_at(by_label, F.col("label")))
    gaps = pairs.select("vec_id", euclidean(F.col("embedding"), F.col("mean")).alias("distance"))
    return gaps.select(
        "vec_id",
        rounded("distance").alias("distance"),
        rounded(kernel(F.col("distance"))).alias("kernel"),
        rounded(kernel(F.col("distance"), 0.1)).alias("sharp"),
    )


@query(
    "l2_normalize",
    f"""WITH {SQL_CELLS}
        SELECT vec_id, pos, round((v + 1) / sqrt(sum((v + 1) * (v + 1)) OVER (PARTITION BY vec_id)), 6) AS x FROM cells""",
)
def normalized(spark: SparkSession, d: str) -> DataFrame:
    shifted = F.transform("embedding", lambda v: v.cast("double") + 1)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(l2_normalize(shifted)).alias("pos", "x"))
    return rows.withColumn("x", rounded("x"))


@query(
    "log_softmax",
    f"""WITH {SQL_CELLS}
        SELECT vec_id, pos, round(v - ln(sum(exp(v)) OVER (PARTITION BY vec_id)), 6) AS x FROM cells""",
)
def log_softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(log_softmax(F.col("embedding"))).alias("pos", "x")
    )
    return rows.withColumn("x", rounded("x"))


@query(
    "masked_softmax",
    f"""WITH {SQL_CELLS}
        SELECT vec_id, pos, round(CASE WHEN v > 0 THEN exp(v) / sum(exp(v)) FILTER (WHERE v > 0) OVER (PARTITION BY vec_id)
                                       ELSE 0 END, 6) AS x FROM cells""",
)
def masked(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("embedding", lambda v: (v > 0).cast("int"))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(masked_softmax(F.col("embedding"), mask)).alias("pos", "x")
    )
    return rows.withColumn("x", rounded("x"))


SQL_TOPK = """WITH pairs AS (
         SELECT a.vec_id AS query_id, b.vec_id AS row_id,
                list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
         FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
       SELECT query_id, row_id, round(distance, 6) AS distance,
              (row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id))::INTEGER AS rank
       FROM pairs QUALIFY rank <= 32"""


@query("knn_topk", SQL_TOPK)
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    found = nearest_neighbours(
        vectors.withColumnRenamed("vec_id", "query_id"),
        vectors.withColumnRenamed("vec_id", "row_id"),
        exclude_self=True,
    )
    return found.select("query_id", "row_id", rounded("distance").alias("distance"), "rank")


@query("knn_stored_cells", SQL_TOPK)
def knn_stored_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same search over an index that was stored in cells, whatever its size."""
    vectors = table(spark, d, "embeddings")
    path = new_path(spark, "cells")
    write_cells(vectors, path, "vec_id", block_rows=64)
    found = search_cells(vectors, read_cells(spark, path), query_id="vec_id", exclude_self=True)
    return found.select(F.col("vec_id").alias("query_id"), "row_id", rounded("distance").alias("distance"), "rank")


def folded_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumn("labels", one_hot(F.col("label"), 10))
    return assign_folds(vectors, ["vec_id"])


SQL_NEAR = f"""folds AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, ntile(6) OVER (ORDER BY {sql_order('2', 'vec_id')}) AS fold FROM embeddings
), near AS (
  SELECT a.vec_id AS query_id, b.label, list_distance(a.x, b.x) AS distance
  FROM folds a JOIN folds b ON a.fold <> b.fold
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) <= 32
), scores AS (
  SELECT query_id, pos::INTEGER AS pos, sum(exp(-distance) * (label = pos)::INTEGER) / sum(exp(-distance)) AS score
  FROM near, range(0, 10) AS r(pos) GROUP BY query_id, pos
)"""


@query("knn_label_scores", f"WITH {SQL_NEAR} SELECT query_id, pos, round(score, 6) AS score FROM scores")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    folded = folded_vectors(spark, d)
    found = nearest_neighbours(
        folded.withColumnRenamed("vec_id", "query_id"),
        folded.withColumnRenamed("vec_id", "row_id"),
        payload=["labels"],
        exclude_group="fold",
    )
    scores = knn_label_scores(found, 10).select("query_id", F.posexplode("knn").alias("pos", "score"))
    return scores.withColumn("score", rounded("score"))


@query("knn_stored_labels", f"WITH {SQL_NEAR} SELECT query_id, pos, round(score, 6) AS score FROM scores")
def knn_stored_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label scores over a stored index; label vectors meet the final neighbours only."""
    folded = folded_vectors(spark, d)
    path = new_path(spark, "cells")
    write_cells(folded, path, "vec_id", payload=["labels"], group="fold", block_rows=64)
    queries = folded.withColumnRenamed("vec_id", "query_id")
    found = search_cells(queries, read_cells(spark, path), exclude_group="fold")
    scores = knn_label_scores(found, 10).select("query_id", F.posexplode("knn").alias("pos", "score"))
    return scores.withColumn("score", rounded("score"))


@query(
    "score_blend",
    f"""WITH {SQL_NEAR}, mixed AS (
          SELECT query_id, pos, 0.75 * {sql_uniform('model', 'query_id', 'pos')} + 0.25 * score AS s FROM scores)
        SELECT query_id, {', '.join(f"max((s > 0.5)::INTEGER) FILTER (WHERE pos = {i}) AS {n}" for i, n in enumerate(CLASSES))}
        FROM mixed GROUP BY query_id""",
)
def score_blend(spark: SparkSession, d: str) -> DataFrame:
    folded = folded_vectors(spark, d)
    model = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: uniform("model", F.col("vec_id"), i))
    scored = folded.select("vec_id", "embedding", "fold", model.alias("scores")).withColumnRenamed("vec_id", "query_id")
    index = folded.withColumnRenamed("vec_id", "row_id")
    mixed = blended_scores(scored, index, CLASSES, exclude_group="fold")
    return threshold_columns(mixed, CLASSES, 0.5, False, ("query_id",))
