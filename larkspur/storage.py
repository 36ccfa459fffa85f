"""Tables by name, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, tuple[DataFrame, str]] = {}  # by identity of the table that was returned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set here only where a local session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/larkspur")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/larkspur-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _paths[id(written)] = (written, path)
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later step reads."""
    for df in tables:
        path = _paths.pop(id(df), (None, None))[1]
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:  # stopped: the folder's own retention applies
            continue
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone at interpreter exit
            return
