"""Joins on series keys, where a null key is a series of its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the keys come from the left side."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])
