"""Structured Streaming forms of the event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import scratch


def hourly_counts(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(hour, event_type, n, total) by event time, of a stream or a table with ts, event_type and value."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counted = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select((F.unix_seconds("window.start") / 3600).cast("long").alias("hour"), "event_type", "n", "total")


def first_requests(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each request once: repeats of (user_id, event_id) within the lateness are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def follow(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    folder, _, name = path.rpartition("/")
    found = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").options(**(options or {}))
    return found.parquet(f"{folder}/{name.replace('.parquet', '.parquet*')}")


def hourly(schema_of: DataFrame, path: str) -> DataFrame:
    """hourly_counts over all files of a Parquet path as a stream that stops at its end."""
    spark = schema_of.sparkSession
    source = follow(spark, path)
    out = scratch(spark, "stream")
    query = (
        hourly_counts(source)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/state")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
