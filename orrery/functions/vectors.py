"""Vector scores as Spark expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _sound(a: Column, b: Column) -> Column:
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(a) == F.size(b)) & ~F.exists(a, odd) & ~F.exists(b, odd)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, unequal lengths or values that aren't finite."""
    n = norm(a) * norm(b)
    return F.when(_sound(a, b) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    return 1 / (1 + F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def inner_product(a: Column, b: Column) -> Column:
    return dot(a, b)


METRICS = {"cosine": cosine, "l2": l2, "ip": inner_product}
