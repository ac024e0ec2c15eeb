"""Written tables between jobs: fold files, embedding index, linear models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.operators.folds import FOLDS, fold_splits
from labelloom.operators.linear import LinearModel
from labelloom.operators.positions import row_position
from labelloom.operators.selection import best_epoch
from labelloom.sources.tables import write_tsv


def write_fold_tables(df: DataFrame, path: str, folds: int = FOLDS, mode: str = "error") -> None:
    """Training and validation rows of every fold in one write, as TSV below
    ``fold=<n>/split=<train|valid>``."""
    write_tsv(fold_splits(df, folds), path, ("fold", "split"), mode)


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Embedding index as Parquet, one folder per fold when it has folds."""
    writer = index.write.mode(mode)
    (writer.partitionBy("fold") if "fold" in index.columns else writer).parquet(path)


def load_index(spark: SparkSession, path: str, held_out: int | None = None) -> DataFrame:
    """The index, or the part a fold was trained on; the held-out folder is not read then."""
    index = spark.read.parquet(path)
    return index if held_out is None else index.filter(index["fold"] != held_out)


def save_linear_model(model: LinearModel, path: str, mode: str = "overwrite") -> None:
    """The model's tables as Parquet, and its label order."""
    spark = model.terms.sparkSession
    order = spark.createDataFrame(list(enumerate(model.labels)), "pos int, label string")
    for name, table in (
        ("terms", model.terms),
        ("coefs", model.coefs),
        ("intercepts", model.intercepts),
        ("labels", order),
    ):
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_linear_model(spark: SparkSession, path: str) -> LinearModel:
    """A model written by :func:`save_linear_model`."""
    order = spark.read.parquet(f"{path}/labels").orderBy("pos").collect()  # one row per label
    return LinearModel(
        tuple(r["label"] for r in order),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/coefs"),
        spark.read.parquet(f"{path}/intercepts"),
    )


def _write_lines(parts: DataFrame, path: str, mode: str) -> None:
    """Lines ``(section, place, line)`` as one file, sorted; the task streams and never holds them."""
    ordered = parts.repartition(1).sortWithinPartitions("section", "place", "line")
    ordered.select("line").write.mode(mode).text(path)


def write_linear_json(model: LinearModel, vectorizer: str, machines: str, mode: str = "overwrite") -> None:
    """The model as the two JSON objects that :func:`read_linear_json` reads.

    Terms are numbered from 0 without gaps. The format is one object a file, so each file is
    written by one task.
    """
    spark = model.terms.sparkSession
    comma = F.when(F.col("place") > 0, ",").otherwise("")
    numbered = row_position(model.terms.select("term", "idf"), ["term"], "place")
    term = F.substring(F.to_json(F.array("term")), 2, 1 << 30)  # as a JSON string, without the brackets
    quoted = F.expr("substring(_t, 1, length(_t) - 1)")
    fixed = spark.createDataFrame(
        [(0, '{"vocabulary": {'), (2, '}, "idf": ['), (4, "]}")], "section int, line string"
    ).select("section", F.lit(0).cast("long").alias("place"), "line")
    words = numbered.withColumn("_t", term).select(
        F.lit(1).alias("section"), "place", F.concat(comma, quoted, F.lit(": "), F.col("place")).alias("line")
    )
    weights = numbered.select(F.lit(3).alias("section"), "place", F.concat(comma, F.col("idf")).alias("line"))
    _write_lines(fixed.unionByName(words).unionByName(weights), vectorizer, mode)

    labels = spark.createDataFrame(list(enumerate(model.labels)), "label_place int, label string")
    heads = labels.join(model.intercepts, "label").select(
        (2 * F.col("label_place")).alias("section"),
        F.lit(-1).cast("long").alias("place"),
        F.concat(
            F.when(F.col("label_place") > 0, "]},").otherwise("{"),
            F.expr("substring(to_json(array(label)), 2, length(to_json(array(label))) - 2)"),
            F.lit(': {"intercept": '),
            F.col("intercept"),
            F.lit(', "coef": ['),
        ).alias("line"),
    )
    listed = F.array(
        *[F.struct(F.lit(i).alias("label_place"), F.lit(n).alias("label")) for i, n in enumerate(model.labels)]
    )
    cells = numbered.select("term", "place", F.inline(listed))
    cells = cells.join(model.coefs, ["label", "term"], "left").select(
        (2 * F.col("label_place") + 1).alias("section"),
        "place",
        F.concat(comma, F.coalesce("coef", F.lit(0.0))).alias("line"),
    )
    end = "]}}" if model.labels else "{}"
    last = spark.createDataFrame([(2 * len(model.labels) + 1, (1 << 62), end)], "section int, place long, line string")
    _write_lines(heads.unionByName(cells).unionByName(last), machines, mode)


def save_index_if_best(
    index: DataFrame, log: DataFrame, num_epochs: int, path: str, run: str = "fold", **names: str
) -> bool:
    """Write the index when the newest epoch of a one-run log is its best so far."""
    newest = log.agg(F.max(names.get("epoch", "epoch"))).first()[0]
    chosen = best_epoch(log, num_epochs, run, **names).first()
    if chosen is None or newest is None or chosen["best_epoch"] != newest:
        return False
    save_index(index, path, mode="overwrite")
    return True


def read_linear_json(spark: SparkSession, vectorizer: str, machines: str, labels: list[str]) -> LinearModel:
    """A model kept as two JSON files: ``{"vocabulary": {term: idx}, "idf": […]}`` and
    ``{label: {"intercept": b, "coef": […]}}``. Each file is one JSON object."""
    words = spark.read.text(vectorizer, wholetext=True).select(
        F.from_json("value", "vocabulary map<string,int>, idf array<double>").alias("m")
    )
    terms = words.select(F.explode("m.vocabulary").alias("term", "idx"), F.col("m.idf").alias("all"))
    terms = terms.select("term", "idx", F.get("all", F.col("idx")).alias("idf"))
    fitted = spark.read.text(machines, wholetext=True).select(
        F.explode(F.from_json("value", "map<string, struct<intercept: double, coef: array<double>>>"))
    )
    fitted = fitted.filter(F.col("key").isin(list(labels)))
    coefs = fitted.select(F.col("key").alias("label"), F.posexplode("value.coef").alias("idx", "coef"))
    return LinearModel(
        tuple(labels),
        terms,
        coefs.join(terms, "idx").select("label", "term", "coef"),
        fitted.select(F.col("key").alias("label"), F.col("value.intercept").alias("intercept")),
    )
