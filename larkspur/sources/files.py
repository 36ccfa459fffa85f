"""Folders of images, and archives of files with their metadata."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import materialize


def scan_images(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """(slug from the folder above, name, bytes, modified) of all images below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(folder)
    columns = [F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("slug"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    return read.select(*columns, *(["content"] if content else []))


def zip_parts(files: DataFrame, *, part_bytes: int = 64 << 20) -> DataFrame:
    """(part, archive): files (name, content) as ZIP archives of bounded size, one or more a task."""

    def pack(batches):
        buffer, held = io.BytesIO(), 0
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                info = zipfile.ZipInfo(name)
                archive.writestr(info, content or b"")
                held += len(content or b"")
                if held >= part_bytes:
                    archive.close()
                    yield _part(buffer.getvalue())
                    buffer, held = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
        if archive.namelist():
            archive.close()
            yield _part(buffer.getvalue())

    return files.select("name", "content").mapInArrow(pack, "archive binary")


def exported(files: DataFrame, metadata: DataFrame, *, part_bytes: int = 64 << 20) -> DataFrame:
    """(kind, archive, rows): an export of one state of the tables: file parts, then metadata as JSON lines in parts.

    Both tables are written first, so that changes made meanwhile don't show in some parts only. Files:
    name, content; only files that the metadata names (column name) are packed.
    """
    frozen, described = materialize(files.select("name", "content"), "files"), materialize(metadata, "metadata")
    parts = zip_parts(frozen.join(described.select("name").distinct(), "name", "left_semi"), part_bytes=part_bytes)
    lines = described.select(F.to_json(F.struct(*[F.col(c) for c in described.columns])).alias("line"))

    def joined(batches):
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            if sum(map(len, held)) >= part_bytes:
                yield _part("\n".join(held).encode(), len(held))
                held = []
        if held:
            yield _part("\n".join(held).encode(), len(held))

    told = lines.mapInArrow(joined, "archive binary, rows long")
    return parts.select(F.lit("files").alias("kind"), "archive", F.lit(None).cast("long").alias("rows")).unionByName(told.select(F.lit("metadata").alias("kind"), "archive", "rows"))


def write_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> None:
    """A few small files below a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    for name, content in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(content))
        stream.close()


def served(pages: DataFrame, folder: str) -> DataFrame:
    """(key, host, url) of pages (key, host, html), each written by its task as a file below folder."""

    def write(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        where.create_dir(path, recursive=True)
        for batch in batches:
            urls = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name = hashlib.sha256(key.encode()).hexdigest()
                with where.open_output_stream(f"{path}/{name}") as out:
                    out.write(html.encode())
                urls.append(f"file://{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(urls, pa.string())], ["key", "host", "url"])

    return pages.select("key", "host", "html").mapInArrow(write, "key string, host string, url string")


def _part(data: bytes, rows: int | None = None):
    import pyarrow as pa

    if rows is not None:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([rows], pa.int64())], ["archive", "rows"])
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])
