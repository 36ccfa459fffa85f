"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = down.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over edges (u, v); nodes without an edge to another are absent.

    Each pass makes every node point at a smaller one, as a table in the shared folder; a hub's edges
    are aggregated before they are shuffled. The number of passes grows with the logarithm of the
    longest path.
    """
    now = materialize(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    seen = _digest(now)
    while True:
        after = materialize(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        digest = _digest(after)
        discard(now)
        if digest == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, seen = after, digest
