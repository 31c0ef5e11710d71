"""Arithmetic on ``array<float>`` vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Vector of length one; null for a zero vector, which has no direction."""
    # The length is bound by the outer transform, so it is not taken anew per element.
    scaled = F.transform(
        F.array(norm(vector)),
        lambda size: F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)),
    )
    return F.get(scaled, 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
