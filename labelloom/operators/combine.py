"""Joins of arguments, labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelloom.operators.positions import row_position
from labelloom.session import new_path


class AlignmentError(ValueError):
    """Raised when labels and predictions do not hold the same ids."""


def combine_columns(
    arguments: DataFrame, labels: DataFrame, id_column: str = "Argument ID"
) -> DataFrame:
    """Inner join on the id; rows without a partner vanish on both sides.

    No hint is given: Spark broadcasts the smaller side when its measured size
    allows and sort-merges (with skew splitting) otherwise.
    """
    return arguments.join(labels, id_column, "inner")


def attach_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Put two tables side by side, row n of one beside row n of the other.

    For inputs that share no id. Both are numbered in a stated order and joined on
    the number. Tables of unequal length raise when the result is computed.
    """
    first = row_position(left, left_order).withColumn("_left", F.lit(True))
    second = row_position(right, right_order).withColumn("_right", F.lit(True))
    unequal = F.raise_error(F.lit("tables put side by side differ in length")).cast("boolean")
    both = F.when(F.col("_left") & F.col("_right"), True).otherwise(unequal)
    return first.join(second, "row_pos", "full").where(both).drop("_left", "_right")


def restore_order(
    source: DataFrame,
    results: DataFrame,
    columns: Sequence[str],
    id_column: str = "Argument ID",
    position: str = "row_pos",
) -> DataFrame:
    """Results in the order of the source rows, with the chosen columns.

    The sort is a range sort over all tasks and belongs at the sink.
    """
    placed = source.select(id_column, position).join(results, id_column, "inner")
    return placed.orderBy(position).select(id_column, *[F.col(f"`{c}`") for c in columns])


def alignment_report(
    labels: DataFrame, predictions: DataFrame, id_column: str = "Argument ID"
) -> DataFrame:
    """One row: rows on each side, matched ids, ids on one side only, repeated ids."""
    sides = labels.select(id_column, F.lit(1).alias("l"), F.lit(0).alias("p")).unionByName(
        predictions.select(id_column, F.lit(0).alias("l"), F.lit(1).alias("p"))
    )
    per_id = sides.groupBy(id_column).agg(F.sum("l").alias("l"), F.sum("p").alias("p"))
    return per_id.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("label_rows"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("prediction_rows"),
        F.count_if((F.col("l") > 0) & (F.col("p") > 0)).alias("matched_ids"),
        F.count_if(F.col("p") == 0).alias("only_labels"),
        F.count_if(F.col("l") == 0).alias("only_predictions"),
        F.count_if((F.col("l") > 1) | (F.col("p") > 1)).alias("repeated_ids"),
    )


def align(
    labels: DataFrame,
    predictions: DataFrame,
    names: Sequence[str],
    id_column: str = "Argument ID",
    check: bool = True,
) -> DataFrame:
    """``(id, t_<label>…, p_<label>…)`` for all labels, joined on the id.

    ``check`` runs :func:`alignment_report` over the joined ids and raises when the two
    sides do not hold the same ids once each. The one join is stored for both uses.
    """
    truth = labels.select(id_column, F.lit(1).alias("_l"), *[F.col(f"`{n}`").alias(f"t_{n}") for n in names])
    guess = predictions.select(id_column, F.lit(1).alias("_p"), *[F.col(f"`{n}`").alias(f"p_{n}") for n in names])
    if not check:
        return truth.join(guess, id_column, "inner").drop("_l", "_p")
    spark = labels.sparkSession
    path = new_path(spark, "aligned")
    truth.join(guess, id_column, "full").write.parquet(path)
    joined = spark.read.parquet(path)
    found = joined.agg(
        F.count_if(F.col("_p").isNull()).alias("only_labels"),
        F.count_if(F.col("_l").isNull()).alias("only_predictions"),
        F.count_if(F.col(f"`{id_column}`").isNull()).alias("null_ids"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(f"`{id_column}`"))).alias("repeated_rows"),
    ).first()
    if any(found):
        raise AlignmentError(f"labels and predictions differ: {found.asDict()}")
    return joined.drop("_l", "_p")
