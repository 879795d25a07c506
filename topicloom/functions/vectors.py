"""Vector columns over ``ARRAY<FLOAT>``: dot, cosine, squared L2, norms, zero test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def nonzero(a: Column) -> Column:
    """True when the vector has a non-zero entry; a zero vector means "no embedding"."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x / length).cast("float"))).otherwise(a)


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: ((x.cast("double") + y.cast("double")) / 2).cast("float"))
