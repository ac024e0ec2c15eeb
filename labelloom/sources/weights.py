"""Label weights: lines ``name,number`` without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _fields(line: str) -> Column:
    return F.split(F.trim(F.col(line)), ",")


def parse_weights(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep…, label, pos_weight)``; lines without exactly two fields are skipped.

    A second field that is no number is an error. Weights are matched by name later
    on, so a skipped line shifts nothing.
    """
    fields = _fields(line)
    return lines.filter(F.size(fields) == 2).select(
        *keep,
        F.trim(F.get(fields, F.lit(0))).alias("label"),
        F.trim(F.get(fields, F.lit(1))).cast("double").alias("pos_weight"),
    )


def malformed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: how many lines :func:`parse_weights` reads and how many it skips."""
    good = F.size(_fields(line)) == 2
    return lines.agg(F.count_if(good).alias("read"), F.count_if(~good).alias("skipped"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, label, pos_weight)`` of a weight file, in line order."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return parse_weights(lines, "value", ("pos",))
