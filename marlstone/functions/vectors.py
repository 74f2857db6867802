"""Probability vectors as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def argmax(v: Column) -> Column:
    """Place from 0 of the largest value, the first on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def rank_of(v: Column, k: Column) -> Column:
    """Rank from 1 of the value at place k; ties go to the lower place."""
    own = F.element_at(v, k + 1)
    return F.size(F.filter(v, lambda x, i: (x > own) | ((x == own) & (i < k)))) + 1


def normalised(v: Column) -> Column:
    """Divided by the total; nulls if it is zero."""
    return F.transform(v, lambda x: F.try_divide(x, total(v)))


def tempered(v: Column, temperature: Column | float) -> Column:
    """Softmax of the logarithms over a temperature; values are clipped to [1e-12, 1]."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    logits = F.transform(v, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))) / t)
    return normalised(F.transform(logits, lambda x: F.exp(x - F.array_max(logits))))


def without_place(v: Column, k: int) -> Column:
    """Drops one class and renormalises."""
    return normalised(F.filter(v, lambda _, i: i != k))


def blended(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(weight) * x + F.lit(1 - weight) * y)


def brier(v: Column, k: Column) -> Column:
    return F.aggregate(F.transform(v, lambda x, i: F.pow(x - F.when(i == k, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def wide(v: Column, names: list[str], prefix: str = "prob_") -> list[Column]:
    return [F.element_at(v, k + 1).alias(prefix + n) for k, n in enumerate(names)]
