"""Sources and sinks: small files written from a table into the shared folder and read back."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from larkspur.operators.ordering import positions
from larkspur.plans.shared import Catalogue
from larkspur.sources import annotations, coco, fetching, files, html, remote, tables
from larkspur.storage import materialize, scratch, table

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS


@C.query("csv_round_trip", "A1 A2", "SELECT n_nationkey, n_name || ', \"' || n_regionkey || '\"' AS n_name FROM nation UNION ALL SELECT 99, 'héhé, q'")
def csv_round_trip(spark, sf_dir):
    """A table as CSV with quotes and commas and back, beside a file that begins with a byte-order mark."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("n_name"))
    path = scratch(spark, "csv")
    tables.write_csv(rows, f"{path}/a")
    files.write_files(spark, f"{path}/b", {"x.csv": "\ufeffn_nationkey,n_name\n99,\"héhé, q\"\n".encode()})
    schema = "n_nationkey int, n_name string"
    return tables.read_csv(spark, f"{path}/a", schema).union(tables.read_csv(spark, f"{path}/b", schema))


@C.query("json_document", "A5", "SELECT r_name AS key, r_regionkey AS n FROM region")
def json_document(spark, sf_dir):
    """One JSON object of objects as rows."""
    rows = table(spark, sf_dir, "region").collect()  # five rows
    path = scratch(spark, "json")
    files.write_files(spark, path, {"doc.json": json.dumps({r.r_name: {"n": r.r_regionkey} for r in rows}).encode()})
    return tables.read_json_document(spark, f"{path}/doc.json", "n:int").select("key", "value.n")


@C.query("json_lines_last_wins", "A6", "SELECT user_id AS id, max(event_id) AS n FROM events GROUP BY user_id")
def json_lines_last_wins(spark, sf_dir):
    """JSON lines with malformed and torn ones: the last of a key stays."""
    path = scratch(spark, "jsonl")
    good = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_id").alias("n"))).alias("value"))
    bad = spark.createDataFrame([("not json",), ('{"id": 1, "n": 99999999',)], "value string")
    good.union(bad).write.text(path)
    return tables.read_json_lines(spark, path, "id long, n long", key="id", order="n")


@C.query("manifest_scan", "A7", "SELECT 'q' || p_partkey AS query_id, 'img/' || p_partkey || '.jpg' AS image_path FROM part")
def manifest_scan(spark, sf_dir):
    """A TSV manifest, checked for repeated ids and empty fields."""
    path = scratch(spark, "tsv")
    key = F.col("p_partkey").cast("string")
    table(spark, sf_dir, "part").select(F.concat(F.lit("q"), key).alias("query_id"), F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("image_path")).write.csv(path, sep="\t", header=True)
    return tables.read_manifest(spark, path)


@C.query("image_folder", "A9", "SELECT 'slug-' || r_regionkey AS slug, lower(r_name) || '.jpg' AS name, length(r_name) + 1 AS bytes FROM region")
def imagescratch(spark, sf_dir):
    """Images below a folder, named by the folder above them; other files are passed over."""
    path = scratch(spark, "images")
    held = {f"slug-{r.r_regionkey}/{r.r_name.lower()}.jpg": b"x" + r.r_name.encode() for r in table(spark, sf_dir, "region").collect()}  # five rows
    files.write_files(spark, path, held | {"slug-0/note.txt": b"no image"})
    return files.scan_images(spark, path).select("slug", "name", "bytes")


PROFILES = {"*": {"title": "(?is)<title>(.*?)</title>", "heading": "(?is)<h1[^>]*>(.*?)</h1>"}, ".org": {"title": "(?is)<title>(.*?)</title>", "lang": '(?i)<html[^>]*lang="([a-z]+)"'}}


@C.query("site_profiles", "A10", """
SELECT page_id, CASE WHEN lower(regexp_extract(url, '//([^/:?#]*)', 1)) LIKE '%.org' THEN '.org' ELSE '*' END AS site, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')), '') AS title,
  CASE WHEN lower(regexp_extract(url, '//([^/:?#]*)', 1)) NOT LIKE '%.org' THEN nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '') END AS heading,
  CASE WHEN lower(regexp_extract(url, '//([^/:?#]*)', 1)) LIKE '%.org' THEN nullif(regexp_extract(html, '(?i)<html[^>]*lang="([a-z]+)"', 1), '') END AS lang FROM pages""")
def site_profiles(spark, sf_dir):
    """Fields of pages by the profile of their site."""
    found = html.site_fields(table(spark, sf_dir, "pages"), PROFILES)
    return found.select("page_id", "site", *[F.col("fields")[k].alias(k) for k in ("title", "heading", "lang")])


@C.query("page_state", "A11", "SELECT p_partkey, '{\"name\": \"' || p_name || '\", \"sizes\": [' || p_size || ', ' || p_size || ']}' AS state FROM part")
def page_state(spark, sf_dir):
    """Page state kept as an array whose objects hold positions."""
    state = F.concat(F.lit('[{"name": 1, "sizes": 2}, "'), "p_name", F.lit('", [3, 3], '), F.col("p_size").cast("string"), F.lit("]"))
    return html.decoded_state(table(spark, sf_dir, "part").select("p_partkey", state.alias("raw")), state_col="raw").select("p_partkey", "state")


@C.query("paged_items", "A12", "SELECT r_regionkey + 1 AS page, '{\"n\": \"' || n_name || '\"}' AS item FROM nation JOIN region ON r_regionkey = n_regionkey")
def paged_items(spark, sf_dir):
    """Items of a paged JSON interface, a page a partition."""
    path = scratch(spark, "pages")
    held = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        held.setdefault(f"{r.n_regionkey + 1}.json", []).append({"n": r.n_name})
    files.write_files(spark, path, {k: json.dumps({"items": v}).encode() for k, v in held.items()})
    spark.dataSource.register(remote.PagedJson)
    local = path.replace("file://", "").replace("file:", "")
    return spark.read.format("paged_json").option("url", f"file://{local}/{{page}}.json").option("last", "5").option("items", "items").load()


@C.query("resumable_fetch", "A12 A13", """
SELECT page_id::VARCHAR AS key, lower(regexp_extract(coalesce(url, ''), '//([^/:?#]*)', 1)) AS host, sha256(coalesce(html, '')) AS sha, 1 AS asked FROM pages""")
def resumable_fetch(spark, sf_dir):
    """Pages fetched by a stream in two runs, the second from the checkpoint of the first, from files that executors wrote."""
    site = scratch(spark, "site")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "//([^/:?#]*)", 1)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    served = materialize(files.served(rows, site), "served")
    at = {n: scratch(spark, n) for n in ("queue", "cache", "log", "fetching")}
    half = F.pmod(F.xxhash64("key"), F.lit(2)) == 0
    for part in (half, ~half):
        fetching.enqueue(served.where(part), at["queue"])
        log = fetching.fetch(spark, queue=at["queue"], cache=at["cache"], log=at["log"], checkpoint=at["fetching"], rate="1000000")
    return log.groupBy("key", "host").agg(F.max(F.sha2("body", 256)).alias("sha"), F.count_if(~F.col("cached")).alias("asked"))


@C.query("fetch_plan", "A13", """
WITH w AS (SELECT page_id AS key, lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host FROM pages), c AS (SELECT doc_id AS key FROM documents WHERE n_chars > 5000), a AS (SELECT event_id % 40 AS key, ts AS t, event_type <> 'error' AS ok FROM events),
f AS (SELECT key, count(*) AS n, max(t) AS last FROM a WHERE NOT ok GROUP BY key), r AS (SELECT key FROM f WHERE n >= 8 OR last > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY),
l AS (SELECT * FROM w WHERE key NOT IN (SELECT key FROM c) AND key NOT IN (SELECT key FROM r))
SELECT key, host, (row_number() OVER (PARTITION BY host ORDER BY key) - 1) // 2 AS second FROM l""")
def fetch_plan(spark, sf_dir):
    """What a resumed run fetches: not cached, not given up or resting after failures, two a second and host."""
    wanted = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.lower(F.regexp_extract("url", "//([^/:?#]*)", 1)).alias("host"))
    cached = table(spark, sf_dir, "documents").where("n_chars > 5000").select(F.col("doc_id").alias("key"))
    attempts = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return tables.fetch_plan(wanted, cached, attempts, now=datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC), tries=8, wait_seconds=86400)


@C.query("remote_scores", "A15", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 2.0::DOUBLE END AS score, CASE WHEN s_suppkey % 7 = 0 THEN 'missing' ELSE 'fine' END AS state FROM supplier")
def remote_scores(spark, sf_dir):
    """Batches through a client of each task; here a local one, which has no score for every seventh row."""

    def client():
        import pandas as pd

        return lambda rows: pd.DataFrame({"score": [None if k % 7 == 0 else 2.0 * k for k in rows.s_suppkey]}, dtype="float64")

    found = remote.scored_remotely(table(spark, sf_dir, "supplier").select("s_suppkey"), client, "score double")
    score = F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score"))
    return found.select("s_suppkey", score.alias("score"), F.when(score.isNull(), F.coalesce("error", F.lit("missing"))).otherwise("fine").alias("state"))


@C.query("report_sink", "A16", "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def report_sink(spark, sf_dir):
    """A summary written by source and read back."""
    rows = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return spark.read.parquet(tables.write_report(rows, scratch(spark, "report"), "summary"))


@C.query("zip_export", "A17", "SELECT 'metadata' AS kind, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS held UNION ALL SELECT 'files', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0)")
def zip_export(spark, sf_dir):
    """An export of frozen tables: how many files its archives hold, and how many rows its metadata."""
    supplier = table(spark, sf_dir, "supplier")
    held = supplier.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("s_name", "UTF-8").alias("content"))
    told = supplier.where("s_suppkey % 2 = 0").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), "s_acctbal")

    def counted(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            n = [rows if kind == "metadata" else len(zipfile.ZipFile(io.BytesIO(data)).namelist()) for kind, data, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["kind", "held"])

    return files.exported(held, told, part_bytes=4096).mapInArrow(counted, "kind string, held long").groupBy("kind").agg(F.sum("held").alias("held"))


@C.query("coco_export", "A18 A16", """
WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id, ['train', 'valid', 'test'][greatest(o_orderkey % 10 - 6, 1)] AS split FROM orders),
x AS (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_quantity * l_quantity / 15000 * 640 * 480), 3) AS area, round(min(l_discount * 640), 4) AS first_x, round(max((l_tax + l_quantity / 100) * 480), 4) AS last_y FROM lineitem GROUP BY 1)
SELECT id, o_orderkey || '.jpg' AS file_name, split, coalesce(n, 0) AS n, area, first_x, last_y FROM i LEFT JOIN x ON k = o_orderkey""")
def coco_export(spark, sf_dir):
    """Orders as images and their lines as outlines, written as COCO documents and read back through the manifest."""
    k = F.col("o_orderkey")
    images = positions(table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("train", "valid", "test"))), F.greatest(k % 10 - 7, F.lit(0)).cast("int")).alias("split")), [k], "id")
    x0, y0, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    points = F.array(F.array(x0, y0), F.array(x0 + q / 150, y0 + q / 100))
    by = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]
    lines = positions(table(spark, sf_dir, "lineitem").select(*by, points.alias("points")), by, "line")
    shape = coco.annotation(F.col("line"), F.col("id"), F.col("points"), F.lit(640), F.lit(480), F.col("l_partkey") % 2)
    held = lines.join(images, by[0] == k).groupBy("id").agg(F.collect_list(shape).alias("annotations"))
    rows = images.join(held, "id", "left").select("split", "id", F.concat(k.cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), "annotations")
    folder = scratch(spark, "coco")
    spark.dataSource.register(coco.Coco)
    rows.write.format("coco").mode("append").option("path", folder).option("categories", json.dumps(["even", "odd"])).save()
    photos, outlines = coco.read_coco(spark, folder)
    box = F.col("bbox")
    told = outlines.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"), F.round(F.min(box[0]), 4).alias("first_x"), F.round(F.max(box[1] + box[3]), 4).alias("last_y"))
    return photos.join(told, "id", "left").select("id", "file_name", "split", F.coalesce("n", F.lit(0)).alias("n"), "area", "first_x", "last_y")


@C.query("yolo_lines", "A18", """
SELECT l_orderkey, l_linenumber, l_partkey, printf('0 %.6f %.6f %.6f %.6f', l_discount + l_quantity / 300, l_tax + l_quantity / 200, l_quantity / 150, l_quantity / 100) AS line FROM lineitem WHERE l_quantity::INTEGER IN (30, 45)""")
def yolo_lines(spark, sf_dir):
    """Boxes of outlines in centre form, one line each."""
    x0, y0, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    points = F.array(F.array(x0, y0), F.array(x0 + q / 150, y0), F.array(x0 + q / 150, y0 + q / 100), F.array(x0, y0 + q / 100))
    b = annotations.box(points)
    line = F.format_string("0 %.6f %.6f %.6f %.6f", b["x"] + b["w"] / 2, b["y"] + b["h"] / 2, b["w"], b["h"])
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity").cast("int").isin(30, 45)).select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


@C.query("prediction_lines", "A19", "SELECT 'q' || doc_id AS query_id, sha256(text) AS image_sha256, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS predicted_slug FROM documents")
def prediction_lines(spark, sf_dir):
    """Predictions as JSON lines, null answers included, and back."""
    path = scratch(spark, "predictions")
    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("q"), key).alias("query_id"), F.concat(F.lit("p"), key).alias("image_path"), F.sha2("text", 256).alias("image_sha256"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("predicted_slug"), F.lit(1.5).alias("latency_ms"))
    tables.write_predictions(rows, path)
    return spark.read.schema("query_id string, image_sha256 string, predicted_slug string").json(path)


@C.query("snapshot_restore", "A20", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal, 'b' AS version FROM supplier")
def snapshot_restore(spark, sf_dir):
    """Two versions of a table; the later one is read."""
    folder = scratch(spark, "versions")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    tables.write_snapshot(rows, folder, "a")
    tables.write_snapshot(rows.withColumn("s_acctbal", F.col("s_acctbal") + 1), folder, "b")
    return tables.latest_snapshot(spark, folder)


@C.query("crawl_queue", "A22 E5", """
WITH f AS (SELECT DISTINCT p_brand AS site, l_orderkey AS key FROM lineitem JOIN part ON p_partkey = l_partkey), v AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F')
SELECT site, key, row_number() OVER (PARTITION BY site ORDER BY key)::INTEGER AS place FROM f WHERE key NOT IN (SELECT key FROM v) QUALIFY place <= 25""")
def crawl_queue(spark, sf_dir):
    """Links found and not visited, at most 25 a site."""
    found = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("site"), F.col("l_orderkey").alias("key"))
    return tables.crawl_queue(found, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), cap=25)
