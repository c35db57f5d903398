"""Column functions over embedding arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the positions both arrays have."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x * x, F.lit(0.0)))
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with norms over full length; null where a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
