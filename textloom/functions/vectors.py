"""Vector arithmetic on array columns. Products are made in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, values: Sequence[float]) -> Column:
    """The product with a known vector: one arithmetic expression, compiled with the stage."""
    return sum((a[i].cast("double") * F.lit(float(v)) for i, v in enumerate(values)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
