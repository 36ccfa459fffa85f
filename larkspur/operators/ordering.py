"""Positions in a global order, and selections that depend on an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.storage import discard, materialize


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df with each row's place in the order, from 1; ties must be broken by the order given.

    Rows are range-partitioned once; a task numbers its own rows and adds those of the partitions before
    it, of which there is one small row each.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def percentiles(df: DataFrame, *, key: str, value: str, ties: list[str], q: float) -> DataFrame:
    """(key, linear, by_index, by_count): a percentile of each key by three conventions.

    linear interpolates; by_index takes place int(q * (n - 1)), by_count min(int(q * n), n - 1), from 0.
    """
    placed = positions(df.select(key, value, *ties), [F.col(key), F.col(value), *map(F.col, ties)])
    span = placed.groupBy(key).agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    at = q * (F.col("n") - 1)
    rows = placed.join(span, key).withColumn("i", F.col("pos") - F.col("start"))
    pick = lambda place: F.max(F.when(F.col("i") == place, F.col(value)))
    low, high = F.floor(at), F.ceil(at)
    by_count = F.least(F.floor(q * F.col("n")), F.col("n") - 1)
    found = rows.groupBy(key).agg(F.first("n").alias("n"), pick(low).alias("low"), pick(high).alias("high"), pick(by_count).alias("by_count"))
    return found.select(key, (F.col("low") + (F.col("high") - F.col("low")) * (at - low)).alias("linear"), F.col("low").alias("by_index"), "by_count")


def first_independent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes that a greedy pass in order of id keeps: those without a kept node before them among their pairs (a, b), a < b.

    Each round keeps what has no undecided node before it and drops what it is paired with, so rounds
    grow with the longest chain and no task needs a whole group.
    """
    edges = materialize(pairs.select("a", "b").distinct(), "pairs")
    kept = nodes.select("id").join(edges.select(F.col("b").alias("id")), "id", "left_anti")
    while True:
        # the nodes that nothing precedes stay; what they precede goes, with its pairs
        free = materialize(edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti"), "free")
        if not free.take(1):
            return kept
        gone = materialize(edges.join(free, edges["a"] == free["id"], "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        left = edges.join(free.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        now = materialize(left.select("a", "b"), "pairs")
        # nodes that lost all the nodes before them and have none after them are kept, too
        alone = edges.select(F.col("b").alias("id")).distinct().join(gone, "id", "left_anti").join(now.select(F.col("b").alias("id")), "id", "left_anti")
        kept = materialize(kept.union(alone), "kept")
        discard(edges, free, gone)
        edges = now


def gap_clusters(boxes: DataFrame, *, key: str, gap: Column) -> DataFrame:
    """(key, cluster, n, top, bottom, area, largest): boxes (key, id, top, bottom, area) in runs along the axis.

    A new cluster begins where a box starts more than `gap` beyond all before it; the one of largest area
    is marked, the first of equals.
    """
    line = Window.partitionBy(key).orderBy("top", "id")
    reach = F.max("bottom").over(line.rowsBetween(Window.unboundedPreceding, -1))
    broken = boxes.withColumn("new", F.when(reach.isNull() | (F.col("top") - reach > gap), 1).otherwise(0))
    runs = broken.withColumn("cluster", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sum("area").alias("area"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area"), "cluster"))
    return grouped.withColumn("largest", best == 1)
