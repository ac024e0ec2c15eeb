"""Shapes of the physical plans."""

import re

import pytest

import __spark_entry__ as registered
from labelloom.operators.folds import assign_folds
from labelloom.operators.metrics import confusion

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["label_prf", "cv_metrics", "linear_predict", "tfidf", "label_overlap", "weighted_bce", "knn_topk",
     "score_blend", "contrastive_loss", "rollup_long", "fold_splits", "shuffle_batches", "pair_distance"],
)
def test_no_cross_join(spark, name):
    text = plan(registered.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_folds_do_not_move_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    outer = [line for line in plan(assign_folds(docs, ["doc_id"])).splitlines() if not line.startswith("   :")]
    assert not any("Exchange" in line for line in outer)


def test_scans_read_only_what_they_need(spark):
    text = plan(registered.queries()["label_confusion"](spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == [
        "doc_id:bigint,lang:string,n_chars:bigint",
        "doc_id:bigint,quality:int,toxic:int",
    ]


def test_confusion_sums_before_it_shuffles(spark):
    df = spark.range(10).selectExpr("cast(id % 2 as int) AS t_x", "cast(id % 3 as int) AS p_x")
    for layout in ("wide", "long"):
        text = plan(confusion(df, ["x"], layout=layout))
        assert "partial_count" in text and text.count("Exchange") == 1


def test_texts_and_index_are_encoded_once(spark):
    """Models are the costly part: each row of both sides goes through them once."""
    from pyspark.sql import functions as F, types as T

    from labelloom.plans.predict import predict_fold_ensemble, predict_text_model

    encoded = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def places(texts):
        encoded.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    def encoder(df, text, out):
        return df.withColumn(out, places(text))

    rows = [(f"a{i}", "x" * i, "c", "against", i % 2) for i in range(1, 31)]
    docs = spark.createDataFrame(rows, "`Argument ID` string, Premise string, Conclusion string, Stance string, y int")
    index = encoder(docs, "Premise", "embedding").select(
        F.col("Argument ID").alias("row_id"), "embedding", F.array("y").alias("labels"), (F.col("y") + 1).alias("fold")
    )
    one = lambda df, text, out: df.withColumn(out, F.array(F.lit(0.5)))
    two = lambda df, text, out: df.withColumn(out, F.array(F.array(F.lit(0.5)), F.array(F.lit(0.5))))
    assert predict_text_model(docs, encoder, one, index.drop("fold"), ["y"]).count() == 30
    assert encoded.value == 60
    assert predict_fold_ensemble(docs, encoder, two, index, ["y"]).count() == 30
    assert encoded.value == 120
