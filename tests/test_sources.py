import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.sources import annotations, files, html, tables
from larkspur.streaming import activity


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Slug,Name\na,\"x, y\"\nb,z\n".encode())
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), "Slug string, Name string").orderBy("Slug").collect()
    assert [(r.Slug, r.Name) for r in rows] == [("a", "x, y"), ("b", "z")]
    tables.write_csv(spark.createDataFrame([("q\"t", "1,2")], "a string, b string"), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), "a string, b string").first() == ("q\"t", "1,2")


def test_json_lines_torn_tail_last_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"a","n":1}\nnot json\n{"id":"a","n":2}\n{"id":"b","n":3}\n{"id":"c","n"')
    rows = tables.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n long", key="id", order="n").collect()
    assert sorted((r.id, r.n) for r in rows) == [("a", 2), ("b", 3)]


def test_json_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"n": 1}, "y": {"n": 2}}')
    assert sorted((r.key, r.value.n) for r in tables.read_json_document(spark, str(tmp_path / "a.json"), "n:int").collect()) == [("x", 1), ("y", 2)]


def test_manifest_rejects_repeated_ids(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("query_id\timage_path\na\tx.jpg\na\ty.jpg\n")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m.tsv"))


def test_unique_rows_and_resume(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, p int")
    assert sorted(r.p for r in tables.unique_rows(df, "k", "p").collect()) == [1, 3]
    assert sorted(r.p for r in tables.unique_rows(df, "k", "p", "last").collect()) == [2, 3]
    assert [r.k for r in tables.still_to_do(df, df.where("k = 'a'"), "k").collect()] == ["b"]


def test_predictions_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("q", "p", "s", None, 1.0)], "query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms double")
    tables.write_predictions(df, str(tmp_path / "p"))
    assert "predicted_slug" in json.loads(spark.read.text(str(tmp_path / "p")).first().value)
    path = tables.write_snapshot(df, str(tmp_path / "s"), "1")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):
        tables.write_snapshot(df, str(tmp_path / "s"), "1")


def test_image_folder_and_zip(spark, tmp_path):
    (tmp_path / "slug-a").mkdir()
    (tmp_path / "slug-a" / "1.jpg").write_bytes(b"abc")
    (tmp_path / "slug-a" / "note.txt").write_bytes(b"x")
    rows = files.scan_images(spark, str(tmp_path), content=True)
    assert [(r.slug, r.name, r.bytes) for r in rows.collect()] == [("slug-a", "1.jpg", 3)]
    archive = files.zip_parts(rows).first().archive
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(archive)).read("1.jpg") == b"abc"


def test_html_fields(spark):
    page = '<title>T</title><meta property="og:x" content="1"><h1>H</h1><a href="/a">x</a><img srcset="s.jpg 200w, l.jpg 800w">'
    row = html.page_fields(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert (row[0].page.title, row[0].page.heading, row[0].page.links, row[0].page.images, row[0].page.meta) == ("T", "H", ["/a"], ["l.jpg"], {"og:x": "1"})
    assert row[1].page.links == []


def test_state_decoding():
    assert html.decode_state('[{"a":1,"b":2},"x",[1,3],7]') == {"a": "x", "b": ["x", 7]}
    assert html.decode_state("bad") is None
    assert html.decode_state('[{"self":0}]')["self"] is not None


def test_annotations(spark):
    square, line = [[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]], [[0.1, 0.2], [0.5, 0.6]]
    bow = [[0.1, 0.1], [0.9, 0.9], [0.9, 0.1], [0.1, 0.9]]
    df = spark.createDataFrame([(1, square, 100, 200), (2, line, 10, 10), (3, bow, 10, 10)], "id int, points array<array<double>>, width int, height int")
    assert [r[0] for r in df.orderBy("id").select(annotations.valid(F.col("points"))).collect()] == [True, True, False]
    first = json.loads(annotations.coco(df.where("id = 1")).first().annotation)
    assert first["bbox"] == pytest.approx([10, 20, 80, 160]) and first["area"] == pytest.approx(0.64 * 20000)
    assert annotations.yolo(df.where("id = 2")).first().line == "0 0.300000 0.400000 0.400000 0.400000"


def test_text_forms(spark):
    row = spark.createDataFrame([("Ёжик Щука, № 5,5",)], "t string").select(T.transliterate(F.col("t")).alias("a"), T.collapsed(F.col("t")).alias("b"), T.first_number(F.col("t")).alias("c"), T.without_marks("t").alias("d")).first()
    assert (row.a, row.b, row.c) == ("ezhik schuka, № 5,5", "ежик щука 5 5", 5.5) and row.d.startswith("ежик")


def test_stream_drops_repeated_requests(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:00:01"), (2, 1, "2024-01-01 00:00:02")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = activity.first_requests(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM once").count() == 2
