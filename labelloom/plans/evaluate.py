"""Evaluate: label table against prediction table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from labelloom.operators.combine import align
from labelloom.operators.metrics import confusion, macro_harmonic, precision_recall_f1
from labelloom.sources.tables import ID, read_predictions


@dataclass(frozen=True)
class Evaluation:
    """Metrics per label, and one row of macro metrics."""

    per_label: DataFrame
    macro: DataFrame


def evaluate(
    labels: DataFrame,
    predictions: DataFrame,
    names: Sequence[str],
    id_column: str = ID,
    group: Sequence[str] = (),
    check: bool = True,
) -> Evaluation:
    """Counts, accuracy, precision, recall, F1 per label and their macro means.

    One join and one aggregation over the data; all that follows has a row per label.
    """
    aligned = align(labels, predictions, names, id_column, check)
    per_label = precision_recall_f1(confusion(aligned, names, group))
    return Evaluation(per_label, macro_harmonic(per_label, group))


def evaluate_files(spark: SparkSession, label_path: str, prediction_path: str) -> Evaluation:
    """The same from two header TSVs; the label file names the labels."""
    labels = read_predictions(spark, label_path)
    names = [c for c in labels.columns if c != ID]
    predictions = read_predictions(spark, prediction_path)
    return evaluate(labels, predictions, names)
