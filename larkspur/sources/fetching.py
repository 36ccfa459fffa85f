"""A queue of addresses as a resumable stream of fetched pages: offsets, a cache by key, an attempts log, a rate by host.

The queue is a Parquet table with a running number; a batch of the stream is a range of it, so a restart from the
checkpoint goes on behind the last finished batch. Inside a batch the cache keeps what a broken run has fetched.
The rows of the stream are the attempts log: every item of the queue once, with its answer or its error.
"""

from __future__ import annotations

import hashlib
import re
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as arrow_dataset
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from larkspur.operators.ordering import positions

ATTEMPT = "key string, host string, url string, at double, cached boolean, body binary, error string"
_FETCH_ERRORS = (OSError, ValueError)


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    where, path = arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    return where, path.rstrip("/")


def _queue(folder: str):
    where, path = _open(folder)
    if where.get_file_info(path).type == arrow_fs.FileType.NotFound:
        return None
    return arrow_dataset.dataset(path, filesystem=where, format="parquet", exclude_invalid_files=False)


def enqueue(wanted: DataFrame, folder: str, *, tasks: int = 8) -> int:
    """Append (key, host, url) to the queue, hosts taking turns, and give its new length. One writer at a time.

    Rows without key or url are an error; a key may be queued again to be asked again later, where the
    cache has no answer. A null host is the empty one. tasks is that of the stream.
    """
    if not wanted.where("key IS NULL OR url IS NULL").isEmpty():
        raise ValueError("null key or url")
    held = _queue(folder)
    start = held.count_rows() if held else 0
    rows = wanted.select(F.col("key").cast("string").alias("key"), F.coalesce("host", F.lit("")).alias("host"), "url")
    numbered = positions(rows, [F.col(c) for c in ("host", "key", "url")], "own")
    first = numbered.groupBy("host").agg(F.min("own").alias("first"))
    turn = numbered.join(first, "host").select("key", "host", "url", (F.col("own") - F.col("first")).alias("turn"))
    placed = positions(turn, [F.col(c) for c in ("turn", "host", "key", "url")], "pos")
    lane = F.crc32(F.col("host").cast("binary")) % tasks
    placed.select((F.col("pos") - 1 + start).alias("pos"), lane.alias("lane"), "key", "host", "url").write.mode("append").parquet(folder)
    return _queue(folder).count_rows()


class Fetching(DataSource):
    """format("fetching"): a stream of ATTEMPT rows.

    Options: queue and cache (folders that all executors reach), tasks (8), rate (requests a second and host; 2),
    timeout (30 seconds). Hosts are dealt to tasks, so a host's requests come from one task, in the order of the queue.
    An error is a row, not a failure; ask again by queueing the key again.
    """

    @classmethod
    def name(cls) -> str:
        return "fetching"

    def schema(self) -> str:
        return ATTEMPT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


@dataclass
class _Range(InputPartition):
    task: int
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.queue, self.cache = options["queue"], options["cache"]
        self.tasks, self.rate, self.timeout = int(options.get("tasks", 8)), float(options.get("rate", 2)), float(options.get("timeout", 30))

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def latestOffset(self) -> dict:
        held = _queue(self.queue)
        return {"pos": held.count_rows() if held else 0}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(t, start["pos"], end["pos"]) for t in range(self.tasks)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        pos = arrow_dataset.field("pos")
        mine = (pos >= partition.start) & (pos < partition.end) & (arrow_dataset.field("lane") == partition.task)
        rows = _queue(self.queue).to_table(columns=["pos", "key", "host", "url"], filter=mine).sort_by("pos")
        where, path = _open(self.cache)
        where.create_dir(path, recursive=True)
        free: dict[str, float] = {}  # when a host may be asked again
        for r in (r for batch in rows.to_batches(max_chunksize=1024) for r in batch.to_pylist()):
            place = f"{path}/{hashlib.sha256(r['key'].encode()).hexdigest()}"
            if where.get_file_info(place).type == arrow_fs.FileType.File:
                with where.open_input_stream(place) as held:
                    yield r["key"], r["host"], r["url"], time.time(), True, held.read(), None
                continue
            time.sleep(max(0.0, free.get(r["host"], 0.0) - time.monotonic()))
            free[r["host"]] = time.monotonic() + 1 / self.rate
            at, body, error = time.time(), None, None
            try:
                with urllib.request.urlopen(r["url"], timeout=self.timeout) as answer:
                    body = answer.read()
            except _FETCH_ERRORS as problem:
                error = type(problem).__name__
            else:
                draft = f"{path}/.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as out:
                    out.write(body)
                where.move(draft, place)
            yield r["key"], r["host"], r["url"], at, False, body, error


def fetch(spark: SparkSession, *, queue: str, cache: str, log: str, checkpoint: str, **options) -> DataFrame:
    """Fetch what the queue holds beyond the checkpoint, append it to the log and give the whole log."""
    spark.dataSource.register(Fetching)
    asked = spark.readStream.format("fetching").option("queue", queue).option("cache", cache).options(**options).load()
    running = asked.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(ATTEMPT).parquet(log)
