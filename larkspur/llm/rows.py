"""Input rows carried whole, so that working columns never clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """One struct column `row` that holds all columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the struct `row` again, some of them replaced."""
    return df.select(*[changed.get(c, field(c)).alias(c) for c in columns])
