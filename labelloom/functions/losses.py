"""Loss of one cell (or one row) as a column expression; operators.losses adds them up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelloom.functions.labels import one_hot, smooth_labels
from labelloom.functions.vectors import bind, log_softmax, total


def sigmoid(x: Column) -> Column:
    """``1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x: Column, y: Column, pos_weight: Column | None = None) -> Column:
    """Binary cross-entropy of a logit, stable for large ``|x|``.

    ``-(w*y*ln s(x) + (1-y)*ln(1-s(x)))`` with ``ln s(x) = min(x,0) - log1p(exp(-|x|))``.
    """
    tail = F.log1p(F.exp(-F.abs(x)))
    log_p = F.least(x, F.lit(0.0)) - tail
    log_q = F.least(-x, F.lit(0.0)) - tail
    weight = F.lit(1.0) if pos_weight is None else pos_weight
    return -(weight * y * log_p + (F.lit(1.0) - y) * log_q)


def asymmetric_cell(
    x: Column,
    y: Column,
    gamma_neg: float = 4.0,
    gamma_pos: float = 1.0,
    clip: float | None = 0.05,
    eps: float = 1e-8,
    pos_weight: Column | None = None,
) -> Column:
    """Asymmetric loss of one logit ``x`` with target ``y`` between 0 and 1.

    ``-(y ln p + (1-y) ln q) * (1 - (y p + (1-y) q)) ^ (y gamma_pos + (1-y) gamma_neg)``, with
    ``q`` clipped. A null target gives null, so sums leave the cell out.
    """
    p = sigmoid(x)
    q = F.lit(1.0) - p
    if clip is not None and clip > 0:
        q = F.least(q + F.lit(clip), F.lit(1.0))
    positive = F.log(F.greatest(p, F.lit(eps)))
    if pos_weight is not None:
        positive = pos_weight * positive
    negative = F.log(F.greatest(q, F.lit(eps)))
    rest = F.lit(1.0) - y
    loss = y * positive + rest * negative
    if gamma_neg > 0 or gamma_pos > 0:
        hit = y * p + rest * q
        loss = loss * F.pow(F.lit(1.0) - hit, y * float(gamma_pos) + rest * float(gamma_neg))
    return -loss


def asymmetric_single_label(
    logits: Column,
    target: Column,
    classes: int,
    gamma_pos: float = 0.0,
    gamma_neg: float = 4.0,
    eps: float = 0.1,
) -> Column:
    """Asymmetric loss of one row with a single true class, with label smoothing."""

    def row_loss(log_p: Column) -> Column:
        hot = one_hot(target, classes)
        focus = F.zip_with(
            log_p,
            hot,
            lambda lp, t: lp
            * F.when(t == 1, F.pow(F.lit(1.0) - F.exp(lp), F.lit(float(gamma_pos)))).otherwise(
                F.pow(F.exp(lp), F.lit(float(gamma_neg)))
            ),
        )
        soft = smooth_labels(hot, eps, classes) if eps > 0 else hot
        return -total(F.zip_with(soft, focus, lambda t, f: t * f))

    return bind(log_softmax(logits), row_loss)
