"""Round trips through the file formats, and the jobs on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.labels import SQL_PLACES, SQL_VOTED, place_taxonomy, weight_lines
from labelloom.catalog.metrics import MACRO, SQL_MACRO, SQL_MACRO_OUT, sql_scored
from labelloom.catalog.registry import (
    LABELS,
    SQL_JUDGED,
    fold_predictions,
    judged,
    query,
    rounded,
    sql_order,
    table,
    texts,
)
from labelloom.catalog.terms import SQL_MARGINS, STOP_WORDS, documents, hashed_model, labelled
from labelloom.functions.labels import one_hot
from labelloom.operators.columns import label_dataset as make_dataset
from labelloom.operators.folds import assign_folds, fold_pair
from labelloom.operators.inference import embed_descriptions, hashed_encoder
from labelloom.operators.linear import predict_svm
from labelloom.operators.positions import file_position, row_position
from labelloom.operators.rollup import label_descriptions
from labelloom.plans.evaluate import evaluate_files
from labelloom.plans.predict import ensemble_vote, predict_fold_ensemble, predict_text_model
from labelloom.plans.train import build_fold_index
from labelloom.session import new_path
from labelloom.sources import (
    load_index,
    load_linear_model,
    parse_taxonomy,
    read_arguments,
    read_labels,
    read_taxonomy_lines,
    read_weights,
    save_index,
    save_linear_model,
    write_fold_tables,
    write_tsv,
)


def arguments(spark: SparkSession, d: str) -> DataFrame:
    """Documents as arguments, each text on one line."""
    return texts(spark, d, "documents", "doc_id", "source", "lang").select(
        F.col("doc_id").cast("string").alias("Argument ID"),
        F.col("source").alias("Conclusion"),
        F.when(F.col("lang") == "en", "against").otherwise("in favor of").alias("Stance"),
        F.trim(F.regexp_replace("text", r"\s+", " ")).alias("Premise"),
    )


SQL_ARGUMENTS = r"""SELECT doc_id::VARCHAR AS "Argument ID", source AS "Conclusion",
  CASE WHEN lang = 'en' THEN 'against' ELSE 'in favor of' END AS "Stance",
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS "Premise", 'test' AS "Usage" FROM documents"""


@query("arguments_tsv", SQL_ARGUMENTS)
def arguments_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "arguments")
    write_tsv(arguments(spark, d), path)
    return read_arguments(spark, path)


def by_argument(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "Argument ID")


@query("labels_tsv", "SELECT doc_id::VARCHAR AS \"Argument ID\", toxic, quality FROM labels")
def labels_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "labels")
    write_tsv(by_argument(table(spark, d, "labels")), path)
    return read_labels(spark, path, ["toxic", "quality"])


@query(
    "evaluate_files",
    f"WITH {SQL_JUDGED}, {sql_scored()}, m AS (SELECT {SQL_MACRO} FROM scored) SELECT {SQL_MACRO_OUT} FROM m",
)
def evaluate_tsv(spark: SparkSession, d: str) -> DataFrame:
    truth, guess = new_path(spark, "truth"), new_path(spark, "guess")
    rows = judged(spark, d)
    for path, mark in ((truth, "t"), (guess, "p")):
        write_tsv(by_argument(rows.select("doc_id", *[F.col(f"{mark}_{n}").alias(n) for n in LABELS])), path)
    return evaluate_files(spark, truth, guess).macro.select(*[rounded(c).alias(c) for c in MACRO])


@query(
    "fold_files",
    f"""WITH f AS (SELECT *, ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS held FROM labels)
        SELECT doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, k::INTEGER AS fold,
               CASE WHEN held = k THEN 'valid' ELSE 'train' END AS split FROM f, range(1, 7) AS r(k)""",
)
def fold_files(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "folds")
    write_fold_tables(assign_folds(table(spark, d, "labels"), ["doc_id"]), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query("weights_file", "SELECT p_name AS label, p_retailprice AS pos_weight FROM part WHERE p_size <= 40")
def weights_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "weights")
    weight_lines(spark, d).select("value").write.text(path)
    return read_weights(spark, path).select("label", "pos_weight")


@query(
    "taxonomy_file",
    """SELECT s_suppkey AS part_pos, 0::BIGINT AS cat_pos, r_name AS category, 0::BIGINT AS val_pos, n_name AS value, s_name AS example
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def taxonomy_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "taxonomy")
    place_taxonomy(spark, d).withColumnRenamed("s_suppkey", "pos").write.json(path)
    taxonomy = read_taxonomy_lines(spark, path)
    return taxonomy.select("part_pos", "cat_pos", "category", "val_pos", "value", F.explode("examples").alias("example"))


@query(
    "embedding_index",
    f"""WITH f AS (SELECT *, ntile(6) OVER (ORDER BY {sql_order('2', 'vec_id')}) AS fold FROM embeddings)
        SELECT vec_id AS row_id, fold::INTEGER AS fold, label, round(list_sum(embedding::DOUBLE[]), 6) AS total
        FROM f WHERE fold <> 2""",
)
def embedding_index(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "index")
    vectors = assign_folds(table(spark, d, "embeddings"), ["vec_id"])
    hot = one_hot(F.col("label"), 10)
    save_index(vectors.select("fold", F.col("vec_id").alias("row_id"), "embedding", hot.alias("labels")), path)
    index = load_index(spark, path, held_out=2)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    label = (F.array_position("labels", 1) - 1).cast("int")
    return index.select("row_id", "fold", label.alias("label"), rounded(total).alias("total"))


@query(
    "linear_model_store",
    f"""WITH {SQL_MARGINS}
        SELECT doc_id, (quality >= 0.5)::INTEGER AS quality, (toxic >= 0.5)::INTEGER AS toxic FROM margins""",
)
def linear_model_store(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "linear")
    save_linear_model(hashed_model(spark, d), path)
    return predict_svm(documents(spark, d), load_linear_model(spark, path), "doc_id", "text", STOP_WORDS)


def sql_hashed(source: str, key: str, text: str) -> str:
    """SQL of :func:`hashed_encoder` with 64 places: ``(key, pos, x)``, as the last of some tables."""
    return rf"""words AS (
  SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM {source}
), places AS (
  SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, count(*) AS c FROM words GROUP BY ALL
), grid AS (
  SELECT {key} AS k, r.pos FROM {source}, range(0, 64) AS r(pos)
), vec AS (
  SELECT k, pos::INTEGER AS pos,
         (coalesce(c, 0) / greatest(1, sqrt(sum(coalesce(c, 0) * coalesce(c, 0)) OVER (PARTITION BY k))))::FLOAT::DOUBLE AS x
  FROM grid LEFT JOIN places USING (k, pos)
)"""


def hashed_index(spark: SparkSession, d: str) -> DataFrame:
    docs = assign_folds(labelled(spark, d), ["doc_id"])
    return build_fold_index(docs, LABELS, hashed_encoder(64), "doc_id", "text", add_prefix=False)


@query(
    "text_index",
    f"""WITH l AS (SELECT doc_id, text, quality, toxic, ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS fold
                   FROM documents JOIN labels USING (doc_id)), {sql_hashed('l', 'doc_id', 'text')}
        SELECT fold::INTEGER AS fold, doc_id AS row_id, quality, toxic, pos, round(x, 6) AS x
        FROM vec JOIN l ON k = doc_id""",
)
def text_index(spark: SparkSession, d: str) -> DataFrame:
    marks = [F.get("labels", F.lit(i)).alias(n) for i, n in enumerate(LABELS)]
    cells = hashed_index(spark, d).select("fold", "row_id", *marks, F.posexplode("embedding").alias("pos", "x"))
    return cells.withColumn("x", rounded(F.col("x").cast("double")))


@query(
    "label_embeddings",
    f"""WITH {SQL_PLACES}, firsts AS (
          SELECT category, value, min(s_suppkey) AS first_at FROM places GROUP BY ALL
        ), described AS (
          SELECT category, category || ' ' || string_agg(value, ' ' ORDER BY first_at, value) AS description
          FROM firsts GROUP BY category
        ), {sql_hashed('described', 'category', 'description').replace('places', 'spots')}
        SELECT k AS category, pos, round(x, 6) AS x FROM vec""",
)
def label_embeddings(spark: SparkSession, d: str) -> DataFrame:
    taxonomy = parse_taxonomy(place_taxonomy(spark, d), "json", F.col("s_suppkey"))
    encoded = embed_descriptions(label_descriptions(taxonomy), hashed_encoder(64))
    cells = encoded.select("category", F.posexplode("embedding").alias("pos", "x"))
    return cells.withColumn("x", rounded(F.col("x").cast("double")))


def _vectors(name: str) -> str:
    return f"SELECT k, list(x ORDER BY pos) AS x FROM {name} GROUP BY k"


SQL_TEXT_PREDICT = rf"""WITH a AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'I disagree that ' ELSE 'I agree that ' END
         || source || ', because ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS premise FROM documents
), {sql_hashed('a', 'doc_id', 'premise')}, asked AS ({_vectors('vec')}
), l AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)
), {sql_hashed('l', 'doc_id', 'text').replace('words', 'words2').replace('places', 'places2').replace('grid', 'grid2')
    .replace('vec', 'vec2')}, indexed AS ({_vectors('vec2')}
), near AS (
  SELECT asked.k, asked.x[1] AS first, quality, toxic, list_distance(asked.x, indexed.x) AS distance
  FROM asked, indexed JOIN l ON l.doc_id = indexed.k
  QUALIFY row_number() OVER (PARTITION BY asked.k ORDER BY list_distance(asked.x, indexed.x), indexed.k) <= 32
)
SELECT k::VARCHAR AS "Argument ID",
       (0.75 * 0.5 + 0.25 * sum(exp(-distance) * quality) / sum(exp(-distance)) > 0.5)::INTEGER AS quality,
       (0.75 * any_value(first) + 0.25 * sum(exp(-distance) * toxic) / sum(exp(-distance)) > 0.5)::INTEGER AS toxic
FROM near GROUP BY k"""


SQL_FOLD_ENSEMBLE = SQL_TEXT_PREDICT[: SQL_TEXT_PREDICT.index("), near AS (")].replace(
    "l AS (SELECT doc_id, text,", f"l AS (SELECT ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS fold, doc_id, text,"
) + """), near AS (
  SELECT asked.k, f, asked.x[1] AS first, quality, toxic, list_distance(asked.x, indexed.x) AS distance
  FROM asked, range(1, 7) AS r(f), indexed JOIN l ON l.doc_id = indexed.k WHERE fold <> f
  QUALIFY row_number() OVER (PARTITION BY asked.k, f ORDER BY list_distance(asked.x, indexed.x), indexed.k) <= 32
), cut AS (
  SELECT k, f,
         (0.75 * (0.35 + 0.05 * f) + 0.25 * sum(exp(-distance) * quality) / sum(exp(-distance)) > 0.5)::INTEGER AS quality,
         (0.75 * (any_value(first) + 0.1 * f) + 0.25 * sum(exp(-distance) * toxic) / sum(exp(-distance)) > 0.5)::INTEGER AS toxic
  FROM near GROUP BY k, f
)
SELECT k::VARCHAR AS "Argument ID", (avg(quality) >= 0.5)::INTEGER AS quality, (avg(toxic) >= 0.5)::INTEGER AS toxic
FROM cut GROUP BY k"""


@query("fold_ensemble_predict", SQL_FOLD_ENSEMBLE)
def fold_ensemble_predict(spark: SparkSession, d: str) -> DataFrame:
    """Six models and their six held-out indexes in one search, then the vote."""

    def scorer(df: DataFrame, text: str, out: str) -> DataFrame:
        first = F.get("embedding", F.lit(0)).cast("double")
        folds = [F.array(F.lit(0.35) + 0.05 * F.lit(f), first + 0.1 * F.lit(f)) for f in range(1, 7)]
        return df.withColumn(out, F.array(*folds))

    return predict_fold_ensemble(arguments(spark, d), hashed_encoder(64), scorer, hashed_index(spark, d), LABELS)


@query(
    "predict_file_order",
    f"""WITH {SQL_VOTED}
        SELECT doc_id::VARCHAR AS "Argument ID", quality, toxic,
               row_number() OVER (ORDER BY md5('order:' || doc_id)) - 1 AS row_pos FROM voted""",
)
def predict_file_order(spark: SparkSession, d: str) -> DataFrame:
    """Arguments in files of no sorted order; the predictions are written as the files stand."""
    source, target = new_path(spark, "unsorted"), new_path(spark, "predictions")
    unsorted = arguments(spark, d).orderBy(F.md5(F.concat(F.lit("order:"), "Argument ID")))
    write_tsv(unsorted, source)
    placed = file_position([read_arguments(spark, source)], ["Argument ID"])
    stacked = by_argument(fold_predictions(spark, d))
    folds = [stacked.filter(F.col("fold") == k).drop("fold") for k in range(1, 7)]
    write_tsv(ensemble_vote(placed, folds, LABELS, position="row_pos"), target)
    return read_labels(spark, target, LABELS).join(file_position([read_labels(spark, target, [])], ["Argument ID"]), "Argument ID")


@query("text_predict", SQL_TEXT_PREDICT)
def text_predict(spark: SparkSession, d: str) -> DataFrame:
    """Texts scored through an index of the labelled ones, with hashed words as the model."""
    encoder = hashed_encoder(64)
    index = hashed_index(spark, d).drop("fold")

    def scorer(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, F.array(F.lit(0.5), F.get("embedding", F.lit(0)).cast("double")))

    docs = arguments(spark, d)
    return predict_text_model(docs, encoder, scorer, index, LABELS)


@query(
    "predict_tsv",
    f"""WITH {SQL_VOTED}
        SELECT doc_id::VARCHAR AS "Argument ID", quality, toxic FROM voted""",
)
def predict_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The prediction job: fold predictions, vote, input order, file."""
    path = new_path(spark, "predictions")
    docs = row_position(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    stacked = fold_predictions(spark, d)
    folds = [stacked.filter(F.col("fold") == k).drop("fold") for k in range(1, 7)]
    write_tsv(by_argument(ensemble_vote(docs, folds, LABELS, "doc_id", "row_pos")), path)
    return read_labels(spark, path, LABELS)


@query(
    "label_dataset",
    f"""WITH f AS (SELECT *, ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS fold FROM labels JOIN documents USING (doc_id))
        SELECT CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS part, md5(text) AS digest,
               toxic AS first, quality AS second FROM f""",
)
def dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = assign_folds(labelled(spark, d).withColumnRenamed("text", "Premise"), ["doc_id"])
    train, test = fold_pair(rows, 1)
    train, test, _ = make_dataset(train, test, ["toxic", "missing", "quality"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select(
        "part",
        F.md5("Premise").alias("digest"),
        F.get("labels", F.lit(0)).alias("first"),
        F.get("labels", F.lit(1)).alias("second"),
    )
