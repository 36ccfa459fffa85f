"""Keyed Parquet tables that take upserts: copy on write of the buckets that a change touches, and a manifest a version.

    folder/files/<write>/bucket=<b>/*.parquet    written once, never changed
    folder/manifests/<version>.json              which write holds each bucket

A version exists when its manifest does. The manifest is written beside and then renamed without overwriting, so of
two writers that start from one version the second fails, and a write that breaks off leaves only files that
no manifest names. Readers follow one manifest, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKET = "bucket"
_NAME = re.compile(r"(\d{8})\.json$")


class VersionConflict(RuntimeError):
    """Another writer made this version first; read again and repeat the change."""


@dataclass
class VersionedTable:
    """A table by key in `folder`, a path that all executors reach. Keys are unique and not null."""

    spark: SparkSession
    folder: str

    # the folder

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *names]))

    def _fs(self):
        return self._path("manifests").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions in order; files that are not manifests are passed over."""
        fs, where = self._fs(), self._path("manifests")
        if not fs.exists(where):
            return []
        found = (_NAME.match(s.getPath().getName()) for s in fs.listStatus(where))
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.folder}: no version {'at all' if version is None else version}")
        stream = self._fs().open(self._path("manifests", f"{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = self._fs(), self._path("manifests", f".{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        keep = gateway.new_array(options, 1)
        keep[0] = options.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        target = self._path("manifests", f"{manifest['version']:08d}.json")
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), keep)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(target):
                raise VersionConflict(f"{self.folder}: version {manifest['version']} exists") from error
            raise

    # rows

    def _bucket(self, key: list[str], buckets: int):
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows (with BUCKET) once, a task a bucket: the write's name and its buckets."""
        name = uuid.uuid4().hex
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(str(self._path("files", name)))
        listed = self._fs().listStatus(self._path("files", name))
        made = [s.getPath().getName() for s in listed]
        return name, sorted(int(d.split("=")[1]) for d in made if d.startswith(f"{BUCKET}="))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets (all if None) with BUCKET; the manifest gives paths, nothing is listed beyond them."""
        schema = StructType.fromJson(manifest["schema"])
        wanted = {int(b): w for b, w in manifest["buckets"].items() if buckets is None or int(b) in set(buckets)}
        if not wanted:
            return self.spark.createDataFrame([], schema.add(BUCKET, IntegerType()))
        paths = [str(self._path("files", w, f"{BUCKET}={b}")) for b, w in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths).withColumn(BUCKET, self._bucket(manifest["key"], manifest["of"]))

    def create(self, rows: DataFrame, key: list[str], *, buckets: int = 64) -> int:
        """Version 1 from rows with unique keys; buckets is fixed for good, so choose it by the size the table will have."""
        if self.versions():
            raise VersionConflict(f"{self.folder}: has versions")
        self._check(rows, key, unique=True)
        name, made = self._write(rows.withColumn(BUCKET, self._bucket(key, buckets)))
        self._publish({"version": 1, "key": key, "of": buckets, "schema": rows.schema.jsonValue(), "buckets": {str(b): name for b in made}})
        return 1

    @staticmethod
    def _check(rows: DataFrame, key: list[str], *, unique: bool) -> None:
        if BUCKET in rows.columns:
            raise ValueError(f"a column may not be called {BUCKET}")
        hole = F.lit(False)
        for k in key:
            hole = hole | F.col(k).isNull()
        if not rows.where(hole).isEmpty():
            raise ValueError(f"null in key {key}")
        if unique and not rows.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated key {key}")

    def upsert(self, changes: DataFrame, *, order: list[str] | None = None, policy: str = "replace", deleted: str | None = None) -> int:
        """The next version: changes by key with policy "replace" (a change wins) or "ignore" (a stored row wins).

        Of a key's changes the last by `order` counts (the first under "ignore"); without order keys may not
        repeat. `deleted` names a boolean column, not stored, of changes that remove their key. Only buckets with
        a changed key are read and written again. No changes make no version.
        """
        if policy not in ("replace", "ignore"):
            raise ValueError(f"policy {policy}")
        old = self.manifest()
        key, columns = old["key"], [f["name"] for f in old["schema"]["fields"]]
        self._check(changes, key, unique=order is None)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        by = [F.desc(c) if policy == "replace" else F.asc(c) for c in order or key]
        first = changes.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_rank = 1")
        latest = first.select(*columns, gone.alias("_gone")).withColumn(BUCKET, self._bucket(key, old["of"]))
        touched = [r[0] for r in latest.select(BUCKET).distinct().collect()]  # at most the number of buckets
        if not touched:
            return old["version"]
        stored = self._rows(old, touched)
        new = latest.where("NOT _gone").drop("_gone")
        if policy == "replace":
            merged = stored.join(latest.select(*key), key, "left_anti").unionByName(new)
        else:
            merged = stored.unionByName(new.join(stored.select(*key), key, "left_anti"))
        name, made = self._write(merged.select(*columns, BUCKET))
        kept = {b: w for b, w in old["buckets"].items() if int(b) not in set(touched)}
        self._publish(old | {"version": old["version"] + 1, "buckets": kept | {str(b): name for b in made}})
        return old["version"] + 1

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the newest."""
        return self._rows(self.manifest(version)).drop(BUCKET)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest `keep` versions and the files that none of those names: how many writes went.

        Run it while nobody writes: files of an unfinished write are named by no version.
        """
        known = self.versions()
        named = {w for v in known[-keep:] for w in self.manifest(v)["buckets"].values()}
        for v in known[:-keep]:
            self._fs().delete(self._path("manifests", f"{v:08d}.json"), False)
        stale = [s.getPath() for s in self._fs().listStatus(self._path("files")) if s.getPath().getName() not in named]
        for path in stale:
            self._fs().delete(path, True)
        return len(stale)
