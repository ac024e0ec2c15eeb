"""Array-of-number functions: distances, norms, softmax."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, as a let-binding would."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(total(gaps))


def kernel(distance: Column, temperature: float = 1.0) -> Column:
    """``exp(-distance / temperature)``."""
    return F.exp(-distance / F.lit(float(temperature)))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    return bind(
        F.sqrt(dot(vector, vector)),
        lambda norm: F.transform(
            vector, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(0.0))
        ),
    )


def _shifted(values: Column) -> Column:
    as_double = F.transform(values, lambda v: v.cast("double"))
    return bind(
        as_double,
        lambda vs: bind(F.array_max(vs), lambda top: F.transform(vs, lambda v: v - top)),
    )


def log_softmax(logits: Column) -> Column:
    """Logarithm of the softmax, shifted by the maximum so that it cannot overflow."""
    return bind(
        _shifted(logits),
        lambda s: bind(
            F.log(total(F.transform(s, lambda v: F.exp(v)))),
            lambda log_sum: F.transform(s, lambda v: v - log_sum),
        ),
    )


def softmax(logits: Column) -> Column:
    """Softmax of an array."""
    return F.transform(log_softmax(logits), lambda v: F.exp(v))


def masked_softmax(logits: Column, mask: Column) -> Column:
    """Softmax in which the cells with mask 0 count as a logit of -1e9."""
    return softmax(
        F.zip_with(
            logits, mask, lambda v, m: F.when(m == 0, F.lit(-1e9)).otherwise(v.cast("double"))
        )
    )
