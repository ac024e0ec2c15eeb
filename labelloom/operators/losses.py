"""Losses over whole tables: sums and means of the cell functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.losses import asymmetric_cell, asymmetric_single_label, bce_with_logits

# Fixed values of the contrastive term.
TEMPERATURE = 0.1
TINY = 1e-12
CONTRASTIVE_SHARE = 0.1


def logit_cells(
    df: DataFrame, labels: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """``(group…, label, x, y)`` from columns ``x_<label>`` and ``t_<label>``; narrow."""
    cells = [
        F.struct(
            F.lit(n).alias("label"),
            F.col(f"`x_{n}`").cast("double").alias("x"),
            F.col(f"`t_{n}`").cast("double").alias("y"),
        )
        for n in labels
    ]
    return df.select(*group, F.inline(F.array(*cells)))


def _weighted(
    cells: DataFrame, weights: DataFrame | None, labels: Sequence[str]
) -> tuple[DataFrame, Column | None]:
    """The cells and the weight of their label, matched by name.

    The weights become one map with a key per label, looked up in place: joining on
    the label would shuffle all cells to as few tasks as there are labels.
    """
    if weights is None:
        return cells, None
    listed = weights.filter(F.col("label").isin(list(labels)))
    by_name = listed.agg(F.map_from_entries(F.collect_list(F.struct("label", "pos_weight"))).alias("m"))
    found = F.try_element_at(F.col("_weights"), F.col("label"))
    missing = F.raise_error(F.concat(F.lit("no weight for label "), F.col("label"))).cast("double")
    return cells.withColumn("_weights", by_name.scalar()), F.coalesce(found, missing)


def bce_loss(
    df: DataFrame,
    labels: Sequence[str],
    weights: DataFrame | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Mean binary cross-entropy over all cells, optionally weighted by label."""
    cells, weight = _weighted(logit_cells(df, labels, group), weights, labels)
    return cells.groupBy(*group).agg(
        F.avg(bce_with_logits(F.col("x"), F.col("y"), weight)).alias("bce")
    )


def asymmetric_loss(
    df: DataFrame,
    labels: Sequence[str],
    gamma_neg: float = 4.0,
    gamma_pos: float = 1.0,
    clip: float | None = 0.05,
    eps: float = 1e-8,
    weights: DataFrame | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Sum of the asymmetric loss over all cells."""
    cells, weight = _weighted(logit_cells(df, labels, group), weights, labels)
    cell = asymmetric_cell(F.col("x"), F.col("y"), gamma_neg, gamma_pos, clip, eps, weight)
    return cells.groupBy(*group).agg(F.sum(cell).alias("asymmetric_loss"))


def single_label_loss(
    df: DataFrame,
    logits: str,
    target: str,
    classes: int,
    gamma_pos: float = 0.0,
    gamma_neg: float = 4.0,
    eps: float = 0.1,
    reduction: str = "mean",
) -> DataFrame:
    """Asymmetric single-label loss: one mean, or a loss per row for any other reduction."""
    loss = asymmetric_single_label(F.col(logits), F.col(target), classes, gamma_pos, gamma_neg, eps)
    if reduction == "mean":
        return df.agg(F.avg(loss).alias("single_label_loss"))
    return df.withColumn("single_label_loss", loss)


def epoch_loss(log: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Mean batch loss per epoch."""
    return log.groupBy(epoch).agg(
        F.avg(loss).alias("train_loss"), F.count(F.lit(1)).alias("batches")
    )


def label_overlap(df: DataFrame, labels: Sequence[str], batch: str = "batch") -> DataFrame:
    """Per row the sum of label dot products with all other rows of its batch.

    ``sum over j of y_i.y_j = y_i.(sum of y) - y_i.y_i``: the label sums of the batch come
    from a window over it, no pair of rows is ever formed.
    """
    own = Window.partitionBy(batch)
    sums = {f"_sum_{i}": F.sum(F.col(f"`{n}`").cast("long")).over(own) for i, n in enumerate(labels)}
    overlap = None
    for i, n in enumerate(labels):
        y = F.col(f"`{n}`").cast("long")
        term = y * F.col(f"_sum_{i}") - y * y
        overlap = term if overlap is None else overlap + term
    joined = df.withColumns(sums).withColumn("overlap", overlap)
    return joined.drop(*[f"_sum_{i}" for i in range(len(labels))])


def contrastive_loss(
    df: DataFrame,
    batch: str = "batch",
    row_id: str = "row_id",
    embedding: str = "embedding",
    labels: str = "labels",
    temperature: float = TEMPERATURE,
    anchor: str = "all",
    most: int = 4096,
) -> DataFrame:
    """``(batch, contrastive)``: supervised contrastive loss of every training batch.

    Rows that share labels are pulled together, measured against all other rows of
    the batch. ``anchor="first"`` adds up only the batch's first row (by ``row_id``).
    A batch is gathered as one array, so it may have at most ``most`` rows; a larger one
    raises. The distances of many batches are then computed at once on Arrow data.
    """
    member = F.struct(
        F.col(row_id).alias("row_id"),
        F.col(embedding).cast("array<double>").alias("x"),
        F.col(labels).cast("array<double>").alias("y"),
    )
    large = F.raise_error(F.concat_ws(" ", F.lit("batch too large:"), F.col(batch)))
    sizes = df.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(batch)))
    checked = sizes.where(F.when(F.col("_size") <= most, True).otherwise(large.cast("boolean")))
    gathered = checked.groupBy(batch).agg(F.sort_array(F.collect_list(member)).alias("rows"))
    flat = gathered.select(
        F.col(batch).cast("long").alias("batch"),
        F.size("rows").alias("size"),
        F.flatten(F.col("rows.x")).alias("x"),
        F.flatten(F.col("rows.y")).alias("y"),
    )

    def losses(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            values = [
                _batch_loss(
                    np.asarray(x).reshape(n, -1), np.asarray(y).reshape(n, -1), temperature, anchor
                )
                for n, x, y in zip(chunk["size"], chunk["x"], chunk["y"])
            ]
            yield pd.DataFrame({"batch": chunk["batch"], "contrastive": values})

    return flat.mapInPandas(losses, "batch long, contrastive double")


def _batch_loss(x: np.ndarray, y: np.ndarray, temperature: float, anchor: str) -> float:
    size = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)
    length = (unit * unit).sum(axis=1)
    gap = length[:, None] + length[None, :] - 2.0 * (unit @ unit.T)
    scaled = np.sqrt(np.maximum(gap, 0.0)) / temperature
    shared = y @ y.T
    np.fill_diagonal(shared, 0.0)
    near = np.exp(-scaled)
    np.fill_diagonal(near, 0.0)
    common = TINY + shared.sum(axis=1)
    log_mass = np.log(TINY + near.sum(axis=1))
    per_row = ((shared / common[:, None]) * (scaled + log_mass[:, None])).sum(axis=1)
    return float((per_row[:1] if anchor == "first" else per_row).sum() / size)


def combined_loss(
    bce: DataFrame, contrastive: DataFrame, batch: str = "batch", share: float = CONTRASTIVE_SHARE
) -> DataFrame:
    """``bce + share * contrastive`` per batch."""
    return bce.join(contrastive, batch).withColumn(
        "loss", F.col("bce") + F.lit(share) * F.col("contrastive")
    )
