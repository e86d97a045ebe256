"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is (nearly) zero."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-9, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector over its length; left as it is when the length is (nearly) zero."""
    length = norm(a)
    return F.when(length > 1e-9, F.transform(a, lambda v: v.cast("double") / length)).otherwise(
        F.transform(a, lambda v: v.cast("double"))
    )
