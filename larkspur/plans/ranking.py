"""Ranks, caps, ordered selections and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import ordering, recommend, search, selection
from larkspur.plans.shared import Catalogue
from larkspur.storage import table

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS

C.sql("catalogue_first_wins", "A3 E7 E8", """
SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM {part}) x WHERE rn = 1""")
C.sql("catalogue_last_wins", "A3 A6", """
SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS rn FROM {part}) x WHERE rn = 1""")
C.sql("group_caps", "E5 A22", """
SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM {part}) x WHERE rn <= 2""")
C.sql("keyset_page", "E12", """
SELECT event_id, user_id, event_type FROM {events} WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 51""")
C.sql("selection_policies", "E16 I4", """
SELECT l_orderkey, max(CASE WHEN by_price = 1 THEN l_partkey END) AS priciest, max(CASE WHEN by_quantity = 1 THEN l_partkey END) AS largest, max(CASE WHEN by_centre = 1 THEN l_partkey END) AS central FROM (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS by_price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS by_quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_partkey) AS by_centre FROM {lineitem}) x GROUP BY l_orderkey""")
C.sql("sliding_limit", "E17", """
WITH e AS (SELECT event_id, user_id, SECONDS(ts) AS s FROM {events})
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id, CAST(floor(s / 900) AS BIGINT)) AS in_slot FROM e""")
C.sql("fingerprint_dedupe", "F5", """
WITH m AS (SELECT l_orderkey, JOINED(SORTED_ITEMS(COLLECT_SET(CAST(l_suppkey + 1000000 AS VARCHAR(20)))), ',') AS members, sum(l_quantity) AS score FROM {lineitem} GROUP BY l_orderkey)
SELECT l_orderkey, members, score FROM (SELECT *, row_number() OVER (PARTITION BY members ORDER BY score DESC, l_orderkey) AS rn FROM m) x WHERE rn = 1""")
C.sql("priority_union", "F7", """
WITH u AS (SELECT l_partkey AS item, 1 AS p FROM {lineitem} WHERE l_quantity = 50 UNION ALL SELECT p_partkey, 2 FROM {part} WHERE p_size = 1 UNION ALL SELECT p_partkey, 3 FROM {part} WHERE p_type = 'PROMO'),
k AS (SELECT item, min(p) AS p FROM u GROUP BY item), b AS (SELECT k.item, k.p, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY k.p, k.item) AS rn FROM k JOIN {part} ON p_partkey = k.item)
SELECT item, p AS priority, p_brand FROM b WHERE rn <= 6""")
C.sql("recency_list", "F8", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn <= 10""")
C.sql("difference_both_ways", "G2", """
SELECT k, side FROM (SELECT p_partkey AS k, 'unsold' AS side FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 48)
UNION ALL SELECT DISTINCT l_suppkey AS k, 'unlisted' AS side FROM {lineitem} WHERE NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = l_suppkey AND s_acctbal > 0)) x""")
C.sql("catalogue_intersection", "G3", """
SELECT p_name AS v FROM {part} WHERE p_size < 10 INTERSECT SELECT p_name FROM {part} WHERE p_size > 40""")
C.sql("merge_ignore", "G4", """
WITH u AS (SELECT c_nationkey AS k, c_custkey AS v, 0 AS o FROM {customer} UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM {supplier})
SELECT k, v, o FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, v) AS rn FROM u) x WHERE rn = 1""")


@C.query("dhondt_feed", "E4 J22", """
WITH n AS (SELECT p_type, sqrt(count(*)) AS w FROM part GROUP BY p_type), s AS (SELECT p_type, w / sum(w) OVER () AS share FROM n),
i AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
SELECT row_number() OVER (ORDER BY round(share / rn, 12) DESC, i.p_type DESC, rn) AS slot, i.p_type, p_partkey FROM i JOIN s ON s.p_type = i.p_type QUALIFY slot <= 60""")
def dhondt_feed(spark, sf_dir, n=60):
    """Slots dealt to styles by the root of their numbers: the next goes to the largest share for the slots so far."""
    part = table(spark, sf_dir, "part")
    roots = part.groupBy("p_type").agg(F.sqrt(F.count("*")).alias("w"))
    shares = roots.crossJoin(F.broadcast(roots.agg(F.sum("w").alias("all")))).select("p_type", (F.col("w") / F.col("all")).alias("share"))
    best = selection.top_per_group(part.withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))), ["p_type"], ["place"], n)
    claim = best.join(shares, "p_type").withColumn("claim", F.round(F.col("share") / F.col("place"), 12))
    first = claim.orderBy(F.desc("claim"), F.desc("p_type"), "place").limit(n)
    return first.select(F.row_number().over(Window.orderBy(F.desc("claim"), F.desc("p_type"), "place")).cast("long").alias("slot"), "p_type", "p_partkey")  # n rows


@C.query("round_robin_host", "E10", """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM h)
SELECT row_number() OVER (ORDER BY rn, host) AS pos, page_id, host FROM r""")
def round_robin_host(spark, sf_dir):
    """Pages in turns of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "//([^/:?#]*)", 1)).alias("host"))
    turn = pages.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    return ordering.positions(turn, [F.col("rn"), F.col("host")]).select("pos", "page_id", "host")


@C.query("entity_folds", "E14 F10", "SELECT p_partkey, ('0x' || left(md5('42:' || p_brand), 8))::BIGINT % 5 AS fold, ('0x' || left(md5('42:' || p_partkey), 8))::BIGINT AS shuffle FROM part")
def entity_folds(spark, sf_dir):
    """A fold by producer, so that all its items fall together, and a seeded shuffle key."""
    digest = lambda c: F.conv(F.left(F.md5(F.concat(F.lit("42:"), F.col(c).cast("string"))), F.lit(8)), 16, 10).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (digest("p_brand") % 5).alias("fold"), digest("p_partkey").alias("shuffle"))


@C.query("gap_clusters", "E15", """
WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS top, floor(epoch(ts))::BIGINT + 3600 AS bottom, round(value, 2)::DECIMAL(18,2) AS area FROM events),
m AS (SELECT *, max(bottom) OVER (PARTITION BY user_id ORDER BY top, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR top - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY top, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM m),
g AS (SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(top) AS top, max(bottom) AS bottom, sum(area) AS area FROM c GROUP BY 1, 2)
SELECT user_id, cluster, n, top, bottom, area::DOUBLE AS area, row_number() OVER (PARTITION BY user_id ORDER BY g.area DESC, cluster) = 1 AS largest FROM g""")
def gap_clusters(spark, sf_dir):
    """Events of an hour each, in runs without a gap of ten minutes, and the run of largest value."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    boxes = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("top"), (at + 3600).alias("bottom"), F.round("value", 2).cast("decimal(18,2)").alias("area"))
    found = ordering.gap_clusters(boxes, key="user_id", gap=F.lit(600))
    return found.withColumn("area", F.col("area").cast("double"))


@C.query("stratified_sample", "E19", """
WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM documents)
SELECT doc_id, source, 'stratum' AS why FROM r WHERE rn <= 2 UNION ALL (SELECT doc_id, source, 'hardest' FROM r WHERE rn > 2 ORDER BY n_chars DESC, doc_id LIMIT 20)""")
def stratified_sample(spark, sf_dir):
    """Two documents a source by hash, then the 20 longest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    first = selection.top_per_group(docs, ["source"], ["h"], 2)
    rest = docs.join(first.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return first.select("doc_id", "source", F.lit("stratum").alias("why")).union(rest.select("doc_id", "source", F.lit("hardest").alias("why")))


@C.query("search_order", "F4", """
SELECT p_partkey, row_number() OVER (ORDER BY contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT DESC, p_retailprice DESC, p_name, p_partkey) AS pos FROM part QUALIFY pos <= 100""")
def search_order(spark, sf_dir, n=100):
    """The first page of a search: title hits, fit, name."""
    hits = F.contains("p_name", F.lit("red")).cast("int") + F.contains("p_name", F.lit("ring")).cast("int")
    order = [F.desc("hits"), F.desc("p_retailprice"), "p_name", "p_partkey"]
    page = table(spark, sf_dir, "part").withColumn("hits", hits).orderBy(*order).limit(n)
    return page.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))  # n rows


@C.query("greedy_mmr", "E6")
def greedy_mmr(spark, sf_dir):
    """Diversified pick of 20 items a size class: score times 1 less 0.35 of the highest similarity to those picked and what repeats."""
    part = table(spark, sf_dir, "part")
    length = F.sqrt(F.pow(F.col("p_size") / 50.0, 2) + F.pow(F.length("p_name") / 20.0, 2) + 0.25)
    axis = lambda f, x: F.struct(F.lit(f).cast("long").alias("f"), F.lit(0).alias("k"), (x / length).alias("x"))
    features = F.array(axis(1, F.col("p_size") / 50.0), axis(2, F.length("p_name") / 20.0), axis(3, F.lit(0.5)))
    word = F.split("p_name", " ")
    pool = part.select(F.pmod("p_size", F.lit(5)).alias("profile"), F.col("p_partkey").alias("item"), (F.col("p_retailprice") / 2000).alias("score"), F.lit("").alias("interest"), F.lit(0.0).alias("share"), F.col("p_type").alias("style"), word[1].alias("grape"), F.col("p_brand").alias("producer"), F.col("p_name").alias("duplicate_of"), features.alias("features"))
    return recommend.picked(pool, n=20, interests=False).select("profile", "slot", "item")


@C.query("near_duplicate_keep", "E9", """
WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
r AS (SELECT label, [{'id': vec_id, 'v': list_transform(e, lambda x: x / n), 's': list_transform(e, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)}] AS one FROM u),
g AS (SELECT label, list(one ORDER BY one[1].id) AS rows FROM r GROUP BY label),
k AS (SELECT list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (len(k.s) - list_dot_product(k.s, x[1].s)) / 2 <= 25 AND round(sqrt(greatest(0, 2 - 2 * list_dot_product(k.v, x[1].v)) / len(k.s)), 6) < 0.158)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT unnest(list_transform(kept, lambda x: x.id)) AS vec_id FROM k""")
def near_duplicate_keep(spark, sf_dir, bits=25, rmse=0.158):
    """Greedy keep list within a label: a vector goes if one kept before is near in signs and in root mean square."""
    refs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), V.unit("embedding").alias("v"))
    return search.kept_apart(refs, bits=bits, rmse=rmse).withColumnRenamed("id", "vec_id")
