"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once a row; an expression inside a lambda is made again for each element."""
    return F.transform(F.array(value), use)[0]


def norm(a: Column) -> Column:
    return once(F.sqrt(dot(a, a)), lambda n: F.when(n == 0, 1.0).otherwise(n))


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    return once(norm(a), lambda n: F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
