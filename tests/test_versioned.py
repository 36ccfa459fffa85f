"""Upserts of stored tables: policies, versions, conflicts and writes that break off."""

import pytest
from pyspark.sql import functions as F

from larkspur.sources.versioned import VersionConflict, VersionedTable


@pytest.fixture
def stored(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.create(spark.range(40).select("id", (F.col("id") * 10).alias("v")), ["id"], buckets=16)
    return t


def rows(df):
    return dict((r.id, r.v) for r in df.collect())


def test_replace_ignore_delete(spark, stored):
    base = {i: i * 10 for i in range(40)}
    change = spark.createDataFrame([(3, 1, 1), (3, 2, 2), (77, 5, 1)], "id long, v long, at int")
    assert stored.upsert(change, order=["at"]) == 2
    assert rows(stored.read()) == base | {3: 2, 77: 5}
    assert rows(stored.read(1)) == base
    assert stored.upsert(spark.createDataFrame([(3, 9), (78, 9)], "id long, v long"), policy="ignore") == 3
    assert rows(stored.read()) == base | {3: 2, 77: 5, 78: 9}
    gone = spark.createDataFrame([(3, None, True), (999, None, True), (4, 1, None)], "id long, v long, gone boolean")
    stored.upsert(gone, deleted="gone")
    want = base | {77: 5, 78: 9, 4: 1}
    del want[3]
    assert rows(stored.read()) == want


def test_only_touched_buckets_are_written(spark, stored):
    before = stored.manifest()["buckets"]
    stored.upsert(spark.createDataFrame([(5, 0)], "id long, v long"))
    after = stored.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_emptied_table_and_no_changes(spark, stored):
    none = spark.createDataFrame([], "id long, v long")
    assert stored.upsert(none) == 1
    stored.upsert(spark.range(40).select("id", F.lit(0).cast("long").alias("v"), F.lit(True).alias("gone")), deleted="gone")
    assert stored.read().collect() == []
    stored.upsert(spark.createDataFrame([(1, 1)], "id long, v long"))
    assert rows(stored.read()) == {1: 1}


def test_broken_write_leaves_the_version(spark, stored):
    bad = spark.range(5).select("id", F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.lit(1)).alias("v"))
    with pytest.raises(Exception, match="lost"):
        stored.upsert(bad)
    assert stored.versions() == [1]
    assert rows(stored.read()) == {i: i * 10 for i in range(40)}
    assert stored.vacuum() >= 0
    assert len(rows(stored.read())) == 40


def test_second_writer_of_a_version_fails(spark, stored):
    held = stored.manifest()
    stored.upsert(spark.createDataFrame([(1, 1)], "id long, v long"))
    with pytest.raises(VersionConflict):
        stored._publish(held | {"version": 2})
    assert rows(stored.read())[1] == 1


def test_reader_of_an_old_version_and_vacuum(spark, stored):
    old = stored.read()
    stored.upsert(spark.range(40).select("id", F.lit(0).cast("long").alias("v")))
    assert rows(old)[7] == 70
    assert stored.vacuum() == 1
    assert stored.versions() == [2] and rows(stored.read())[7] == 0


def test_keys_are_checked(spark, stored):
    with pytest.raises(ValueError, match="null"):
        stored.upsert(spark.createDataFrame([(None, 1)], "id long, v long"))
    with pytest.raises(ValueError, match="repeated"):
        stored.upsert(spark.createDataFrame([(1, 1), (1, 2)], "id long, v long"))
    with pytest.raises(ValueError, match="no version"):
        stored.read(9)
