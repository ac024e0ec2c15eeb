"""Command line for the three jobs, run with ``spark-submit`` or ``python -m labelloom``.

    evaluate LABELS.tsv PREDICTIONS.tsv [--report FOLDER]
    train ARGUMENTS.tsv LABELS.tsv TAXONOMY.json MODELS [--folds 6] [--augment 0]
    predict MODELS TAXONOMY.json OUTPUT ARGUMENTS.tsv [ARGUMENTS.tsv …] [--folds 6]

Both take --stop-words english (the default), none, or the path of a file with one word a line.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from labelloom.functions.text import english_stop_words
from labelloom.operators.columns import preview, stack
from labelloom.operators.metrics import table_profile
from labelloom.operators.linear import predict_svm
from labelloom.operators.positions import file_position
from labelloom.operators.rollup import taxonomy_levels
from labelloom.plans import cross_validate_svm, ensemble_vote, evaluate_files, prepare
from labelloom.sources import (
    load_linear_model,
    read_arguments,
    read_labels,
    read_taxonomy,
    save_linear_model,
    write_fold_tables,
    write_tsv,
)
from labelloom.sources.tables import ID


def level_names(spark: SparkSession, path: str, level: int) -> list[str]:
    """Label names of one taxonomy level, in order; as many as the taxonomy has."""
    names = taxonomy_levels(read_taxonomy(spark, path)).filter(F.col("level") == level)
    return [r["name"] for r in names.orderBy("pos").collect()]


def stop_words(spark: SparkSession, choice: str) -> tuple[str, ...]:
    """English words, none, or the lines of a file (a list short enough for a plan)."""
    if choice in ("english", "none"):
        return english_stop_words() if choice == "english" else ()
    return tuple(r["value"] for r in spark.read.text(choice).collect() if r["value"])


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    result = evaluate_files(spark, args.labels, args.predictions)
    rounded = [F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    per_label = result.per_label.select("label", *rounded)
    if args.report:
        write_tsv(per_label, f"{args.report}/labels", mode="overwrite")
        write_tsv(result.macro, f"{args.report}/macro", mode="overwrite")
    per_label.show(per_label.count(), truncate=False)  # a row per label
    result.macro.show(truncate=False)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    arguments = read_arguments(spark, args.arguments, "train")
    names = level_names(spark, args.taxonomy, args.level)
    prepared = prepare(arguments, read_labels(spark, args.labels, names), args.folds)
    table_profile(prepared).show()
    preview(prepared, [ID]).show()
    models, report = cross_validate_svm(
        prepared, names, args.folds, args.augment, stop_words=stop_words(spark, args.stop_words)
    )
    for number, model in models.items():
        save_linear_model(model, f"{args.models}/fold={number}")
    write_fold_tables(prepared, f"{args.models}/tables", args.folds, "overwrite")
    write_tsv(report, f"{args.models}/f1", mode="overwrite")


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    inputs = [read_arguments(spark, path, "test") for path in args.arguments]
    arguments = stack(*inputs)
    names = level_names(spark, args.taxonomy, args.level)
    placed = file_position(inputs, [ID])
    words = stop_words(spark, args.stop_words)
    folds = [
        predict_svm(arguments, load_linear_model(spark, f"{args.models}/fold={n}"), stop_words=words)
        for n in range(1, args.folds + 1)
    ]
    voted = ensemble_vote(placed, folds, names, position="row_pos")
    write_tsv(voted, args.output, mode="overwrite")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="labelloom")
    jobs = parser.add_subparsers(required=True)
    job = jobs.add_parser("evaluate")
    job.add_argument("labels")
    job.add_argument("predictions")
    job.add_argument("--report")
    job.set_defaults(run=evaluate)
    job = jobs.add_parser("train")
    for name in ("arguments", "labels", "taxonomy", "models"):
        job.add_argument(name)
    job.add_argument("--augment", type=float, default=0.0)
    job.set_defaults(run=train)
    other = jobs.add_parser("predict")
    for name in ("models", "taxonomy", "output"):
        other.add_argument(name)
    other.add_argument("arguments", nargs="+")
    other.set_defaults(run=predict)
    for each in (job, other):
        each.add_argument("--folds", type=int, default=6)
        each.add_argument("--level", type=int, default=2)
        each.add_argument("--stop-words", default="english")
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("labelloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
