"""All folds at once against one fold after the other."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators.crossval import fold_idf, fold_term_counts, held_out_f1, held_out_margins
from labelloom.operators.linear import LinearModel, linear_margins
from labelloom.operators.tfidf import fit_idf

TEXTS = ["red red fish", "blue fish", "red bird sings", "", None, "only here", "blue blue bird", "fish bird red", "the fish"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3 + 1, i % 2, (i // 2) % 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id int, text string, fold int, a int, b int")


def test_frequencies_by_subtraction(docs):
    counts = fold_term_counts(docs, "id", "text", ["the"])
    found = {(r["fold"], r["term"]): (r["df"], r["idf"]) for r in fold_idf(counts, docs).collect()}
    want = {}
    for fold in (1, 2, 3):
        for r in fit_idf(docs.where(F.col("fold") != fold), "text", ["the"]).collect():
            want[fold, r["term"]] = (r["df"], pytest.approx(r["idf"]))
    assert found == want
    assert (3, "only") not in found and (1, "only") in found


def test_margins_and_f1_of_each_fold(spark, docs):
    counts = fold_term_counts(docs, "id", "text")
    terms = fold_idf(counts, docs)
    both = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label")
    draw = (F.pmod(F.xxhash64("term", "label", "fold"), F.lit(100)) / 50.0 - 1.0).alias("coef")
    coefs = terms.select("fold", "term", both).select("fold", "label", "term", draw)
    intercepts = spark.createDataFrame(
        [(f, n, 0.1 * f) for f in (1, 2, 3) for n in "ab"], "fold int, label string, intercept double"
    )
    margins = held_out_margins(counts, terms, coefs, intercepts, ["a", "b"], "id")
    found = {r["id"]: (r["fold"], r["a"], r["b"]) for r in margins.collect()}
    want = {}
    for fold in (1, 2, 3):
        own = F.col("fold") == fold
        model = LinearModel(
            ("a", "b"), *[t.where(own).drop("fold") for t in (terms, coefs, intercepts)]
        )
        for r in linear_margins(docs.where(own), model, "id", "text").collect():
            want[r["id"]] = (fold, pytest.approx(r["a"]), pytest.approx(r["b"]))
    assert found == want and len(found) == len(TEXTS)
    scores = {(r["fold"], r["label"]): r["f1"] for r in held_out_f1(margins, docs, ["a", "b"], "id").collect()}
    truth = {r["id"]: (r["a"], r["b"]) for r in docs.collect()}
    for fold in (1, 2, 3):
        for at, label in enumerate("ab"):
            pairs = [(truth[i][at], found[i][1 + at] >= 0.5) for i in found if found[i][0] == fold]
            hit = sum(t and p for t, p in pairs)
            total = sum(t for t, _ in pairs) + sum(p for _, p in pairs)
            assert scores[fold, label] == pytest.approx(2 * hit / total if total else 0.0)


def test_no_documents(docs):
    none = docs.limit(0)
    assert fold_idf(fold_term_counts(none, "id", "text"), none).count() == 0
