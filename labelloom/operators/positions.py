"""Row numbers, seeded order and batches without a one-task global window.

A window without ``partitionBy`` sorts the whole table in one task. Here rows are
numbered in parts: count per part, running offsets over the few parts, and the
number within the part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.portable import digest
from labelloom.session import new_path, shared_folder

# The seeded order key is uniform hex, so its first four digits cut the table into
# 65,536 even parts at any size. This is also the proven bound of the offsets table.
BUCKET_DIGITS = 4
ROW_BITS = 33


def order_key(seed: object, keys: Sequence[str]) -> Column:
    """A seeded sort key, made unique by the row's own keys."""
    return F.concat_ws(":", digest(seed, *keys), *[F.col(k).cast("string") for k in keys])


def _bucket(key: str) -> Column:
    return F.substring(F.col(key), 1, BUCKET_DIGITS)


def bucket_offsets(df: DataFrame, key: str) -> DataFrame:
    """``(bucket, rows, start, total)`` per leading-digit bucket; at most 65,536 rows."""
    counts = df.groupBy(_bucket(key).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return counts.select(
        "bucket",
        "rows",
        F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("start"),
        F.sum("rows").over(everything).alias("total"),
    )


def seeded_position(
    df: DataFrame, keys: Sequence[str], seed: object, out: str = "position"
) -> DataFrame:
    """Zero-based place of every row in a seeded shuffle of the table.

    ``keys`` must identify a row. The table is shuffled once, by bucket.
    """
    keyed = df.withColumn("_order", order_key(seed, keys))
    offsets = F.broadcast(bucket_offsets(keyed, "_order").select("bucket", "start"))
    placed = keyed.withColumn("bucket", _bucket("_order")).join(offsets, "bucket")
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("_order"))
    return placed.withColumn(out, F.col("start") + within - 1).drop("bucket", "start", "_order")


def seeded_batches(
    df: DataFrame,
    keys: Sequence[str],
    seed: object,
    batch_size: int = 24,
    epoch: int = 0,
    out: str = "batch",
) -> DataFrame:
    """Shuffle the rows by seed and epoch and cut them into fixed-size batches."""
    placed = seeded_position(df, keys, f"{seed}:{epoch}", "_position")
    return batch_of(placed, "_position", batch_size, out).drop("_position")


def batch_of(df: DataFrame, position: str, batch_size: int = 24, out: str = "batch") -> DataFrame:
    """Batch number of a zero-based position; the last batch may be short."""
    return df.withColumn(out, F.floor(F.col(position) / F.lit(batch_size)))


def row_position(df: DataFrame, order: Sequence[str], out: str = "row_pos") -> DataFrame:
    """Zero-based place of every row in a stated total order.

    A range sort spreads the rows over tasks; the reliable checkpoint fixes which
    row lies in which part, so that counting and numbering agree even when a task
    runs again. The offsets table has one row per part.
    """
    shared_folder(df.sparkSession)
    parted = df.orderBy(*order).checkpoint().withColumn("_at", F.monotonically_increasing_id())
    parted = parted.withColumn("_part", F.shiftright(F.col("_at"), ROW_BITS))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_start"))
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        parted.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + within)
        .drop("_at", "_part", "_start")
    )


def file_position(
    inputs: Sequence[DataFrame], keys: Sequence[str], out: str = "row_pos"
) -> DataFrame:
    """``(keys…, out)``: zero-based place of every row as the rows stand in their files.

    ``inputs`` are file scans, with nothing between them and the file but projections; their
    rows follow in the order of the list, the files of one input in the order of their paths.
    Only keys and a row's file, block and number in its task are written, never the row itself;
    one row per block of a file then gives the offsets. Every number comes from the written
    keys, so a task that runs again changes none.
    """
    spark = inputs[0].sparkSession
    scanned = [
        df.select(
            *keys,
            F.lit(n).alias("_input"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        ).withColumn("_at", F.monotonically_increasing_id())
        for n, df in enumerate(inputs)
    ]
    path = new_path(spark, "file-order")
    for n, df in enumerate(scanned):
        df.write.parquet(f"{path}/{n}")
    rows = spark.read.parquet(*[f"{path}/{n}" for n in range(len(scanned))])
    split = ["_input", "_file", "_block"]
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    running = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    offsets = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(running), F.lit(0))).drop("_rows")
    placed = rows.join(offsets, split)
    return placed.select(*keys, (F.col("_start") + F.col("_at") - F.col("_first")).alias(out))
