"""The first rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, place: str | None = None) -> DataFrame:
    """The first n rows of each group, with their places if a column is named; ties must be broken by the order given."""
    name = place or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
    return ranked if place else ranked.drop(name)


def pool_for(n: int) -> int:
    """How many of the best compete for n slots: the reference's pool."""
    return max(40 * n, 300)
