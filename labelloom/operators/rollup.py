"""Value taxonomy: level lists, label descriptions, roll-up of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F


def taxonomy_levels(taxonomy: DataFrame) -> DataFrame:
    """``(level, pos, name)``: level 1 are the values, level 2 the categories.

    Names keep the order of their first appearance. The last step ranks label names
    only, a list as short as the taxonomy.
    """
    names = taxonomy.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(2).alias("level"),
                    F.col("category").alias("name"),
                    F.struct("part_pos", "cat_pos", F.lit(0).cast("long").alias("val_pos")).alias("at"),
                ),
                F.struct(
                    F.lit(1).alias("level"),
                    F.col("value").alias("name"),
                    F.struct("part_pos", "cat_pos", "val_pos").alias("at"),
                ),
            )
        )
    )
    first = names.groupBy("level", "name").agg(F.min("at").alias("at"))
    in_level = Window.partitionBy("level").orderBy("at", "name")
    return first.select("level", (F.row_number().over(in_level) - 1).alias("pos"), "name")


def label_descriptions(taxonomy: DataFrame) -> DataFrame:
    """``(category, description)``: the category followed by its values, joined by blanks."""
    values = taxonomy.groupBy("category", "value").agg(
        F.min(F.struct("part_pos", "cat_pos", "val_pos")).alias("at")
    )
    listed = values.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("values")
    )
    return listed.select(
        "category",
        F.concat_ws(" ", F.col("category"), F.col("values.value")).alias("description"),
    )


def roll_up_wide(
    df: DataFrame, children: Mapping[str, Sequence[str]], keep: Sequence[str]
) -> DataFrame:
    """Category labels from wide value labels: 1 where any child is 1; narrow."""
    rolled = []
    for category, values in children.items():
        cells = [F.col(f"`{v}`") for v in values]
        rolled.append((F.greatest(*cells) if len(cells) > 1 else cells[0]).alias(category))
    return df.select(*keep, *rolled)


def roll_up_long(
    cells: DataFrame, taxonomy: DataFrame, keys: Sequence[str], unknown: str = "raise"
) -> DataFrame:
    """Category labels from rows ``(keys…, value, y)``: the maximum over the children.

    A value that the taxonomy lacks, or a null one, fails the job. With ``unknown="keep"`` such
    cells are rolled up under a null category instead, so that nothing goes uncounted.
    The taxonomy is a small table; Spark broadcasts it when its size allows. The
    maximum combines on the map side.
    """
    if unknown not in ("raise", "keep"):
        raise ValueError("unknown must be 'raise' or 'keep'")
    # a name of its own, so that a null category in the taxonomy is no missing value
    parents = taxonomy.select("category", "value").distinct().withColumn("_known", F.lit(True))
    found = cells.join(parents, "value", "left")
    if unknown == "raise":
        message = F.concat(F.lit("value outside the taxonomy: "), F.coalesce(F.col("value"), F.lit("null")))
        stray = F.raise_error(message).cast("string")
        found = found.withColumn("category", F.when(F.col("_known"), F.col("category")).otherwise(stray))
    return found.groupBy(*keys, "category").agg(F.max("y").alias("y"))
