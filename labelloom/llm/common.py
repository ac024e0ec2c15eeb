"""Helpers shared by the operators: stored tables, row keys, word splitting.

Conventions of every operator here: a null text is an empty text; input columns that an
operator does not need are never read, so extra columns may have any name; internal columns
start with ``_lm_``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.session import new_path

#: Stands for a null id inside join keys only; results keep the null.
NO_ID = -(1 << 63)

#: Separators of words: ASCII white space, as bytes.split() takes it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here.

    A lost executor costs at most the tasks since the last stored table, and random or
    order-dependent steps before it are fixed by what was written.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two columns that tell rows apart: the id, and a digest of the text.

    Rows that agree in both are repeated rows; they share one fate in every operator.
    """
    return (
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_lm_id"),
        F.xxhash64(F.col(text)).alias("_lm_text"),
    )


KEY = ["_lm_id", "_lm_text"]


def doc_id() -> Column:
    """The id out of a row key. Ids travel through Python in the key, where none is null:
    pandas would turn a column with nulls into doubles and round large ids."""
    return F.when(F.col("_lm_id") != F.lit(NO_ID), F.col("_lm_id")).alias("doc_id")


def keyed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The row key followed by the wanted columns."""
    return df.select(*row_key(), *columns)


#: Bits of a membership filter (1 MB); it is always this large, whatever it holds.
FILTER_BITS = 1 << 23


def membership_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit per value of a long column modulo ``bits`` (a power of two), as ``bits / 64`` words.

    It may pass values that are not there, never miss one, so an exact step must follow. A
    fuller filter passes more; results are the same.
    """
    words = ids.groupBy(F.expr(f"shiftright(pmod(`{column}`, {bits}L), 6)").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {bits}L) & 63 AS int))")).alias("bits")
    )
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def in_filter(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 values the filter passes."""
    bit = values & ((len(words) << 6) - 1)
    return (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


#: Keys that hold more than one in so many rows are joined by broadcast: at most that many.
HOT_KEYS = 4096


def joined_hot(rows: DataFrame, table: DataFrame, key: str, n: str, most: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with their one row of a table, whatever share of the rows a key holds.

    Column ``n`` of the table says how many rows have the key. Keys with more than one in
    ``most`` of all rows are at most ``most`` many and are broadcast; no other is frequent, so
    the rest meets by a shuffle without skew. The table should be stored and narrow.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * most > total
    hot = table.where(is_hot)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot), key)
    return often.unionByName(seldom)
