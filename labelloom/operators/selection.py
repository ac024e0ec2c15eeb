"""Choosing the epoch whose model is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The smallest gain that counts, and how many epochs without one are borne.
MIN_GAIN = 0.0002
PATIENCE = 10


def best_epoch(
    log: DataFrame,
    num_epochs: int,
    run: str = "fold",
    epoch: str = "epoch",
    score: str = "f1",
    min_gain: float = MIN_GAIN,
    patience: int = PATIENCE,
) -> DataFrame:
    """``(run, best_epoch, best_f1, stop_epoch)`` per run; epochs count from 0.

    A new best must beat the old one by more than ``min_gain`` (the first is measured
    against 0). The run stops once ``patience`` epochs passed without one and more
    than half of ``num_epochs`` are over; what follows cannot change it. ``best_epoch``
    is null when no epoch counted. An epoch that is null, outside ``0 … num_epochs - 1``
    or logged twice in a run raises when the result is computed.

    Which epoch is best depends on the path, so a run's rows are folded in order. They
    are first counted per epoch, so a run is never more than ``num_epochs`` rows.
    """
    steps = F.sort_array(
        F.collect_list(
            F.struct(F.col(epoch).cast("int").alias("e"), F.col(score).cast("double").alias("s"))
        )
    )
    start = F.struct(
        F.lit(0.0).alias("best"),
        F.lit(None).cast("int").alias("at"),
        F.lit(0).alias("waited"),
        F.lit(None).cast("int").alias("stop"),
    )

    def advance(state, step):
        better = step["s"] - state["best"] > min_gain
        waited = F.when(better, 0).otherwise(state["waited"] + 1)
        out = ~better & (waited >= patience) & (step["e"] > num_epochs // 2)
        moved = F.struct(
            F.when(better, step["s"]).otherwise(state["best"]).alias("best"),
            F.when(better, step["e"]).otherwise(state["at"]).alias("at"),
            waited.alias("waited"),
            F.when(out, step["e"]).alias("stop"),
        )
        return F.when(state["stop"].isNotNull(), state).otherwise(moved)

    fits = F.coalesce((F.col(epoch) >= 0) & (F.col(epoch) < num_epochs) & (F.col("_rows") == 1), F.lit(False))
    named = F.concat_ws(" ", F.lit("epoch out of range or repeated:"), F.col(run), F.col(epoch))
    per_epoch = log.groupBy(run, epoch).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("_rows"))
    per_epoch = per_epoch.where(F.when(fits, True).otherwise(F.raise_error(named).cast("boolean")))
    return (
        per_epoch.groupBy(run)
        .agg(F.aggregate(steps, start, advance).alias("end"))
        .select(
            run,
            F.col("end.at").alias("best_epoch"),
            F.col("end.best").alias("best_f1"),
            F.col("end.stop").alias("stop_epoch"),
        )
    )
