"""Argument files as a stream.

The row-wise functions (stance prefix, thresholds, encoders, copies) work on the
stream as they are; per-batch joins and aggregations run in ``write_stream``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from labelloom.sources.tables import CONCLUSION, ID, PREMISE, STANCE, TAB, USAGE

ARGUMENTS = T.StructType([T.StructField(c, T.StringType()) for c in (ID, CONCLUSION, STANCE, PREMISE, USAGE)])


def stream_arguments(spark: SparkSession, folder: str, default_usage: str = "test") -> DataFrame:
    """New argument files below ``folder`` as a streaming table.

    The fifth column, the usage, may be missing in a file or empty in a row; the default
    stands in for it.
    """
    reader = spark.readStream.schema(ARGUMENTS).option("sep", TAB).option("header", True)
    rows = reader.option("quote", "").option("escape", "").csv(folder)
    return rows.withColumn(USAGE, F.coalesce(F.col(USAGE), F.lit(default_usage)))


def write_stream(
    arguments: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score every micro-batch with a batch function and write it below its own number.

    A batch that runs again overwrites its own folder, so each row is written once.
    """

    def save(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        arguments.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
