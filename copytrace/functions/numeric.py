"""Numeric column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def percent(x: Column) -> Column:
    return round_even(x * F.lit(100.0), 2)


def rank_score(x: Column) -> Column:
    """Score used for ordering: scores equal up to summation noise tie."""
    return round_even(x, 9)


def inverse_ratio(value: Column, low: float) -> Column:
    """1 at zero, falling to 0 at ``low`` and above."""
    if low <= 0:
        return F.lit(0.0)
    return F.when(value >= F.lit(low), F.lit(0.0)).otherwise((F.lit(low) - value) / F.lit(low))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def scaled_exponentials(logits: Column, temperature: float | Column = 1.0) -> Column:
    """exp((z - max z) / T) per class, the stable numerator of a softmax."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    return F.transform(logits, lambda z: F.exp((z - top) / t))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    e = scaled_exponentials(logits, temperature)
    total = vector_sum(e)
    return F.transform(e, lambda x: x / total)


def log_loss(logits: Column, true_index: Column, temperature: float | Column = 1.0) -> Column:
    """Negative log-likelihood of class ``true_index`` (0-based), log-sum-exp form."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    total = vector_sum(scaled_exponentials(logits, t))
    return F.log(total) - (F.element_at(logits, true_index.cast("int") + 1) - top) / t


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector as doubles; a zero vector stays zero."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))
