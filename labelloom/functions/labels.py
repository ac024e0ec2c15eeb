"""Label algebra on columns: vectors, thresholds, smoothing, blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def labels_to_vector(labels: Sequence[str]) -> Column:
    """Wide 0/1 columns as one ``array<int>`` in the given order."""
    return F.array(*[F.col(f"`{name}`").cast("int") for name in labels])


def vector_columns(vector: str, labels: Sequence[str], type_name: str | None = None) -> list[Column]:
    """One column per label out of a vector, named and ordered as ``labels``."""
    picked = [F.get(F.col(vector), F.lit(i)) for i in range(len(labels))]
    return [
        (p.cast(type_name) if type_name else p).alias(name) for p, name in zip(picked, labels)
    ]


def binarize(score: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """1 when the score passes the threshold, else 0.

    Scores of a model are cut with ``score > threshold``; means over folds and
    linear margins with ``score >= threshold`` (``inclusive=True``).
    """
    passed = score >= threshold if inclusive else score > threshold
    return F.when(passed, 1).otherwise(0)


def one_hot(index: Column, size: int) -> Column:
    """``array<int>`` of the given size with a single 1 at ``index``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def smooth_labels(targets: Column, epsilon: float, size: int) -> Column:
    """``t * (1 - epsilon) + epsilon / size`` for every component."""
    return F.transform(targets, lambda t: t * F.lit(1.0 - epsilon) + F.lit(epsilon / size))


def blend(model: Column, neighbours: Column, model_share: float = 0.75) -> Column:
    """Weighted sum of two score vectors; the shares add up to 1."""
    return F.zip_with(
        model, neighbours, lambda m, n: m * F.lit(model_share) + n * F.lit(1.0 - model_share)
    )
