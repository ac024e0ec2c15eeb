"""Cross-validation folds: exact and balanced, by hash, or by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from labelloom.functions.portable import uniform
from labelloom.functions.vectors import bind
from labelloom.operators.positions import BUCKET_DIGITS, bucket_offsets, order_key

# Six folds, shuffled with seed 2.
FOLDS = 6
SEED = 2


def assign_folds(
    df: DataFrame,
    keys: Sequence[str],
    folds: int = FOLDS,
    seed: object = SEED,
    group: str | None = None,
    exact: bool = True,
    out: str = "fold",
    check: bool = False,
) -> DataFrame:
    """Add the fold (1-based) in which a row is held out for validation.

    ``exact``: sizes differ by at most one; the first ``n mod folds`` folds get one
    row more. The table itself is never shuffled: one counting pass finds the
    buckets that hold a fold border, only the rows of those few buckets are ranked,
    and each row is then compared with the ``folds - 1`` border keys. Rows that share
    their keys share a fold, so the sizes hold for distinct keys only; ``check`` runs a
    count first and raises on repeated keys.

    ``exact=False`` draws the fold from the key's hash alone (sizes are about even).
    ``group`` does the same with the group's hash, so that a group stays in one fold.
    """
    if group is not None or not exact:
        drawn = uniform(seed, *([group] if group is not None else keys))
        return df.withColumn(out, F.floor(drawn * folds).cast("int") + 1)

    if check:
        again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").first()
        if again is not None:
            raise ValueError(f"keys are repeated, folds would be uneven: {again.asDict()}")
    if folds == 1:
        return df.withColumn(out, F.lit(1))
    keyed = df.withColumn("_order", order_key(seed, keys))
    borders = _border_keys(keyed.select("_order"), folds)
    # bound once: the optimizer would otherwise hash the row anew for every border
    passed = bind(
        F.col("_order"),
        lambda key: F.size(F.filter(F.col("_borders"), lambda border: border <= key)),
    )
    with_borders = keyed.withColumn("_borders", borders.scalar())
    return with_borders.withColumn(out, passed + 1).drop("_order", "_borders")


def _border_keys(keyed: DataFrame, folds: int) -> DataFrame:
    """One row: the sort keys at which the folds 2, 3, … begin."""
    extra = F.col("total") % folds
    small = ((F.col("total") - extra) / folds).cast("long")
    border_rows = F.transform(
        F.sequence(F.lit(1), F.lit(folds - 1)), lambda f: f * small + F.least(f, extra)
    )
    start, end = F.col("start"), F.col("start") + F.col("rows")
    inside = F.filter(border_rows, lambda row: (row >= start) & (row < end))
    borders = bucket_offsets(keyed, "_order").select(
        "bucket", F.transform(inside, lambda row: row - start + 1).alias("ranks")
    )
    in_bucket = Window.partitionBy("bucket").orderBy("_order")
    ranked = (
        keyed.withColumn("bucket", F.substring("_order", 1, BUCKET_DIGITS))
        # at most folds - 1 buckets are left: a list that small may be broadcast
        .join(F.broadcast(borders.filter(F.size("ranks") > 0)), "bucket")
        .withColumn("rank", F.row_number().over(in_bucket).cast("long"))
        .filter(F.array_contains("ranks", F.col("rank")))
    )
    return ranked.agg(F.sort_array(F.collect_list("_order")).alias("borders"))


def fold_splits(df: DataFrame, folds: int = FOLDS, fold: str = "fold", out: str = "split") -> DataFrame:
    """Every row once per fold, marked ``valid`` in its own fold and ``train`` in the others."""
    held = F.col(fold)
    return (
        df.withColumn("_held", held)
        .withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn(out, F.when(F.col("_held") == F.col(fold), "valid").otherwise("train"))
        .drop("_held")
    )


def fold_pair(df: DataFrame, number: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``(train, valid)`` of one fold as two filters."""
    return df.filter(F.col(fold) != number), df.filter(F.col(fold) == number)


def group_leakage(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups whose rows lie in more than one fold, with their row count."""
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("rows"), F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold"))
        .filter(F.col("first_fold") != F.col("last_fold"))
    )
