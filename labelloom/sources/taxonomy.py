"""The value taxonomy: nested JSON objects, category -> value -> list of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TAXONOMY_TYPE = "map<string, map<string, array<string>>>"


def parse_taxonomy(df: DataFrame, json: str = "json", position: Column | None = None) -> DataFrame:
    """``(part_pos, cat_pos, category, val_pos, value, examples)`` from JSON objects, in key order.

    Each row holds one object. Several objects are parts of one taxonomy: ``position``
    orders them, or without it the order of the rows. Categories are ordered by part and,
    in a part, by place.
    """
    base = F.monotonically_increasing_id() if position is None else position.cast("long")
    entries = F.map_entries(F.from_json(F.col(json), TAXONOMY_TYPE))
    categories = df.select(base.alias("_base"), F.posexplode(entries).alias("_at", "_category"))
    values = categories.select(
        F.col("_base").alias("part_pos"),
        F.col("_at").cast("long").alias("cat_pos"),
        F.col("_category.key").alias("category"),
        F.posexplode(F.map_entries("_category.value")).alias("_val", "_value"),
    )
    return values.select(
        "part_pos",
        "cat_pos",
        "category",
        F.col("_val").cast("long").alias("val_pos"),
        F.col("_value.key").alias("value"),
        F.col("_value.value").alias("examples"),
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy in one JSON file, which may span lines."""
    return parse_taxonomy(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def read_taxonomy_lines(spark: SparkSession, path: str, position: str = "pos") -> DataFrame:
    """A taxonomy in JSON lines ``{"pos": n, "json": "{…}"}``: one part per line."""
    lines = spark.read.schema(f"{position} long, json string").json(path)
    return parse_taxonomy(lines, "json", F.col(position))
