"""Numeric conventions of the metrics: halves round up, missing numbers are zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 4) -> Column:
    """Rounds towards plus infinity at halves, unlike ``round``, which goes away from zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def number(value: Column) -> Column:
    """Null and NaN are 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); 0 where all values are equal."""
    span = high - low
    return (value - low) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def dot(left: Column, right: Column) -> Column:
    """Dot product over the shorter length, summed from the first component on."""
    size = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(1), size), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """Unit length, rounded to 6 digits; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(round_half_up(x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm), 6)))


def weighted_sum(weights: dict[str, float], of=F.col) -> Column:
    return reduce(lambda a, b: a + b, [of(name) * F.lit(float(w)) for name, w in weights.items()])
