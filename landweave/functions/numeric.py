"""Numeric comparisons and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    x, y = F.abs(a), F.abs(b)
    return F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def relative_difference(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.abs(F.log(a / b)))


def rarity(frequency: Column) -> Column:
    return 1 / (1 + F.coalesce(frequency, F.lit(0)))


def log1p_positive(c: Column) -> Column:
    return F.when(c > 0, F.log1p(c)).otherwise(0.0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax2(a: Column, b: Column) -> Column:
    """Probability of the second of two classes."""
    return F.exp(b) / (F.exp(a) + F.exp(b))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def hybrid(supervised: Column, isolation: Column, low: float, high: float) -> Column:
    """Blend of a probability with an isolation score scaled to its range."""
    return 0.75 * supervised + 0.25 * clip01((isolation - low) / (high - low))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda acc, v: acc + v))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda acc, v: acc * v)


def weighted_geometric_mean(channels: list[tuple[Column, float]], floor: float = 1e-6) -> Column:
    """Over the present channels only; null when none is."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in channels), F.lit(0.0))
    logs = sum((F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(floor))) * w).otherwise(0.0) for c, w in channels), F.lit(0.0))
    return F.when(weight > 0, F.exp(logs / weight))
