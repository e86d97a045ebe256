"""Rows that travel whole beside working columns, so that no column name of the caller can clash with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, **working: Column) -> DataFrame:
    """``row`` (a struct of all columns) and the working columns."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[c.alias(name) for name, c in working.items()])


def unpacked(rows: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The columns of ``row``, then the added ones; an added one replaces a column of its name."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in added], *[c.alias(name) for name, c in added.items()])
