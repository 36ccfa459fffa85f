"""Connected components, and splits that keep components together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import positions
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


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v). Nodes given without an edge are their own.

    Alternating star contraction: each pass makes every node point at a smaller one, as a table in the
    shared folder; a hub's edges are aggregated before they are shuffled, and tables of earlier passes go.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = _digest(now)
    while True:
        after = materialize(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        digest = _digest(after)
        discard(now)
        if digest == seen:
            break
        now, seen = after, digest
    found = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = after.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = found.union(roots)
    if nodes is None:
        return found
    alone = nodes.select("node").distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return found.union(alone)


def grouped_split(parts: DataFrame, shares: tuple[float, float] = (0.15, 0.15), seed: str = "42") -> DataFrame:
    """(node, component, split): components in hash order, the first share to test, the next to validation, the rest to training.

    At least one component each; with fewer than three components all is training.
    """
    components = parts.select("component").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256))
    placed = positions(components, [F.col("h"), F.col("component")])
    total = placed.agg(F.count("*").alias("n"))
    test, validation = (F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(s), 0)) for s in shares)
    split = F.when(F.col("n") < 3, "train").when(F.col("pos") <= test, "test").when(F.col("pos") <= test + validation, "validation").otherwise("train")
    named = placed.crossJoin(F.broadcast(total)).select("component", split.alias("split"))  # one row
    return parts.join(named, "component").select("node", "component", "split")
