"""Text augmentation by a rate: whole copies plus a sampled part of one more."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.portable import uniform
from labelloom.functions.text import split_words, swap_adjacent, swap_rounds
from labelloom.functions.vectors import bind

Augmenter = Callable[[Column, Column, Column], Column]


def random_swap(seed: object = 2, share: float = 0.3, least: int = 1, most: int = 10) -> Augmenter:
    """Swaps seeded neighbouring words; a share of the words, within bounds."""

    def apply(text: Column, row_id: Column, copy: Column) -> Column:
        def swapped(words: Column) -> Column:
            rounds = swap_rounds(words, share, least, most)
            return F.array_join(swap_adjacent(words, rounds, seed, row_id, copy), " ")

        return bind(split_words(text), swapped)

    return apply


def sample_rows(df: DataFrame, keys: Sequence[str], rate: float, seed: object) -> DataFrame:
    """Keep each row with probability ``rate``; the same rows at every run."""
    return df.filter(uniform(seed, *keys) < rate)


def augment(
    df: DataFrame,
    rate: float,
    id_column: str = "Argument ID",
    text: str = "Premise",
    augmenter: Augmenter | None = None,
    seed: object = 2,
) -> DataFrame:
    """The rows plus ``rate`` augmented copies of them.

    A rate of 3.6 gives three copies of every row and a fourth of 60 % of the rows.
    Copies carry the id ``<id>_aug<k>``. The copies are exploded beside the original
    in the same task, so nothing is shuffled and the table is read once.
    """
    if rate < 0:
        raise ValueError("rate must not be negative")
    whole = int(rate)
    rest = rate - whole
    apply = augmenter or random_swap(seed)
    # every row sees its original (copy -1), the whole copies 0…whole-1 and the sampled one
    copies = F.sequence(F.lit(-1), F.lit(whole if rest > 0 else whole - 1))
    exploded = df.withColumn("_copy", F.explode(copies))
    if rest > 0:
        drawn = uniform(f"{seed}:rest", F.col(id_column))
        exploded = exploded.filter((F.col("_copy") < whole) | (drawn < rest))
    original = F.col("_copy") < 0
    row_id = F.col(id_column).cast("string")
    marked = F.concat(row_id, F.lit("_aug"), F.col("_copy").cast("string"))
    changed = apply(F.col(text), F.col(id_column), F.col("_copy"))
    # the text first: its draws depend on the original id
    return (
        exploded.withColumn(text, F.when(original, F.col(text)).otherwise(changed))
        .withColumn(id_column, F.when(original, row_id).otherwise(marked))
        .drop("_copy")
    )
