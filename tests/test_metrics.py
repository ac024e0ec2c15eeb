"""Metrics on hand-worked numbers."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators.columns import MissingColumnError, predict_one_baseline, require_columns
from labelloom.operators.combine import AlignmentError, align
from labelloom.operators.ensemble import majority_vote
from labelloom.operators.metrics import (
    balanced_weights,
    confusion,
    f1_report,
    label_counts,
    macro_harmonic,
    macro_mean_f1,
    metric_bundle,
    positive_weights,
    precision_recall_f1,
)
from labelloom.plans.evaluate import evaluate

LABELS = ["Universalism: concern", "never true", "never called"]


def pairs(spark):
    rows = [
        ("a", 1, 0, 1, 1, 0, 0),
        ("b", 1, 0, 0, 0, 0, 0),
        ("c", 0, 0, 1, 1, 1, 0),
        ("d", 0, 0, 0, 0, 0, 0),
        ("e", 1, 0, 0, 1, 0, 0),
    ]
    names = ["id", *[f"t_{n}" for n in LABELS], *[f"p_{n}" for n in LABELS]]
    return spark.createDataFrame(rows, names)


def test_confusion_and_zero_denominators(spark):
    for layout in ("wide", "long"):
        scored = precision_recall_f1(confusion(pairs(spark), LABELS, layout=layout))
        found = {r["label"]: r for r in scored.collect()}
        first = found[LABELS[0]]
        assert (first["tp"], first["fp"], first["fn"], first["tn"]) == (2, 1, 1, 1)
        assert first["precision"] == pytest.approx(2 / 3) and first["recall"] == pytest.approx(2 / 3)
        assert found["never true"]["recall"] == 0.0 and found["never true"]["f1"] == 0.0
        assert found["never called"]["precision"] == 0.0 and found["never called"]["accuracy"] == 0.6


def test_values_other_than_one_count_as_zero(spark):
    df = spark.createDataFrame([(2, 1), (None, None), (1, 3)], "t_x int, p_x int")
    row = confusion(df, ["x"]).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 1, 1, 1)


def test_macro_f1_variants(spark):
    scored = precision_recall_f1(confusion(pairs(spark), LABELS))
    macro = macro_harmonic(scored).first()
    assert macro["macro_precision"] == pytest.approx(2 / 9)
    assert macro["macro_f1"] == pytest.approx(2 / 9)
    assert macro_mean_f1(scored, 6).first()["avg_f1"] == pytest.approx(round(0.666667 / 3, 6))
    report = {r["label"]: r["f1"] for r in f1_report(scored, 2).collect()}
    assert report["avg-f1-score"] == 0.22 and report[LABELS[0]] == 0.67


def test_macro_f1_is_zero_when_nothing_is_found(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "t_x int, p_x int")
    assert macro_harmonic(precision_recall_f1(confusion(df, ["x"]))).first()["macro_f1"] == 0.0


def test_bundle_agrees_with_its_parts(spark):
    df = spark.createDataFrame([(1, 0.7), (0, 0.5), (1, 0.2)], "t_x int, s_x double")
    row = metric_bundle(df, ["x"]).first()
    assert row["accuracy_thresh"] == pytest.approx(2 / 3)  # 0.5 is not above the threshold
    assert row["f1_score"] == {"x": 0.666667} and row["macro_avg_f1"] == 0.666667


def test_align_joins_on_the_id_and_reports_differences(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "id string, x int")
    guess = spark.createDataFrame([("b", 1), ("a", 1)], "id string, x int")
    result = evaluate(truth, guess, ["x"], "id")
    row = result.per_label.first()
    assert (row["tp"], row["fp"]) == (1, 1)
    for wrong in ([("a", 1)], [("a", 1), ("b", 1), ("b", 0)], [("a", 1), ("c", 1)]):
        with pytest.raises(AlignmentError):
            align(truth, spark.createDataFrame(wrong, "id string, x int"), ["x"], "id")


def test_one_baseline_has_recall_one(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "id string, x int")
    result = evaluate(truth, predict_one_baseline(truth, ["x"], "id"), ["x"], "id")
    assert result.per_label.first()["recall"] == 1.0


def test_even_tie_is_a_yes(spark):
    votes = [("tie", v) for v in (1, 1, 1, 0, 0, 0)] + [("minority", v) for v in (1, 1, 0, 0, 0, 0)]
    df = spark.createDataFrame(votes, "id string, x int").repartition(5)
    assert dict(majority_vote(df, ["x"], "id").collect()) == {"tie": 1, "minority": 0}


def test_weights(spark):
    df = spark.createDataFrame([(1, 0)] * 2 + [(0, 0)] * 6, "x int, none int")
    weights = dict(positive_weights(df, ["x", "none"]).collect())
    assert weights == {"x": 3.0, "none": None}
    counts = {r["label"]: r for r in label_counts(df, ["x"]).collect()}["x"]
    assert weights["x"] * counts["positives"] + counts["positives"] == counts["rows"]
    balanced = {(r["label"], r["y"]): r["weight"] for r in balanced_weights(df, ["x", "none"]).collect()}
    assert balanced == {("x", 0): 8 / 12, ("x", 1): 2.0, ("none", 0): 0.5}


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumnError, match="Premise"):
        require_columns(spark.range(1).withColumn("Argument ID", F.lit("a")), ["Argument ID", "Premise"])
