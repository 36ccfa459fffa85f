"""Readers and writers of delimited text, JSON and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *, sep: str = ",") -> DataFrame:
    """CSV with a header, UTF-8 with or without a byte-order mark; a row that doesn't fit the schema fails the read."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding="UTF-8", mode="FAILFAST", enforceSchema=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; Spark's commit protocol makes the result appear whole or not at all."""
    df.write.csv(path, header=True, mode="overwrite", quote='"', escape='"')


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object of key to value as rows (key, value) with values of the given schema."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{schema}>>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, *, key: str, order: str) -> DataFrame:
    """JSON lines; malformed or torn lines are dropped, and of a key's lines the last by `order` stays."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(key).isNotNull())
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))
    return rows.withColumn("_rn", last).where("_rn = 1").drop("_rn")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Two-column TSV of query_id and image_path; raises ValueError if an id repeats or a field is empty."""
    rows = read_csv(spark, path, "query_id string, image_path string", sep="\t")
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("keys"), F.count_if(F.coalesce(F.trim("query_id") == "", F.lit(True)) | F.coalesce(F.trim("image_path") == "", F.lit(True))).alias("empty")).first()
    if found.n != found.keys or found.empty:
        raise ValueError(f"manifest: {found.n} rows, {found.keys} ids, {found.empty} with an empty field")
    return rows


def unique_rows(df: DataFrame, key: str, position: str, keep: str = "first") -> DataFrame:
    """One row a key: the first or the last by position."""
    order = F.col(position).asc() if keep == "first" else F.col(position).desc()
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left: wanted rows whose key has not been done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines (query_id, image_path, image_sha256, predicted_slug, latency_ms), null fields written."""
    df.select("query_id", "image_path", "image_sha256", "predicted_slug", "latency_ms").write.json(path, mode="overwrite", ignoreNullFields=False)


def write_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """An immutable version of a table: a path of its own, never overwritten."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.parquet(path, mode="error")
    return path


def fetch_plan(wanted: DataFrame, cached: DataFrame, attempts: DataFrame, *, now, tries: int = 3, wait_seconds: int = 3600, per_second: int = 2) -> DataFrame:
    """(key, host, second): what a resumed run fetches and when, from wanted (key, host).

    Cached keys are done. Of the attempts (key, at, ok) a key that failed `tries` times is given up, and
    one that failed within `wait_seconds` of now rests. A host gets at most per_second fetches a second.
    """
    failed = attempts.where("not ok").groupBy("key").agg(F.count("*").alias("failures"), F.max("at").alias("last"))
    resting = failed.where((F.col("failures") >= tries) | (F.unix_seconds("last") > F.unix_seconds(F.lit(now)) - wait_seconds))
    left = wanted.join(cached.select("key").distinct(), "key", "left_anti").join(resting, "key", "left_anti")
    turn = F.row_number().over(Window.partitionBy("host").orderBy("key")) - 1
    return left.select("key", "host", F.floor(turn / per_second).cast("long").alias("second"))


def crawl_queue(found: DataFrame, visited: DataFrame, *, cap: int) -> DataFrame:
    """(site, key, place): links found and not visited, each once, at most `cap` a site in order of key."""
    fresh = found.select("site", "key").distinct().join(visited.select("key").distinct(), "key", "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("key"))).where(F.col("place") <= cap).select("site", "key", "place")


def write_report(df: DataFrame, folder: str, name: str, *, by: str | None = None) -> str:
    """A manifest, coverage or summary table as Parquet below a folder, partitioned if asked; it appears whole or not at all."""
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The version of a table with the greatest name below a folder of write_snapshot()."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder.rstrip('/')}/version=*")
    last = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), "version", "left_semi")  # one row
