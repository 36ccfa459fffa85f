"""Engagement: filters, joins and aggregates over interactions, catalogue coverage and event logs.

Roles: part = item (p_brand producer, p_type style), orders/lineitem = interactions of a profile
(o_custkey) with an item, events = activity log, customer/supplier/nation = accounts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import ledger, ordering
from larkspur.plans.shared import Catalogue
from larkspur.storage import table

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS

_RATED = "(SELECT o_custkey AS profile, l_partkey AS item, 1 + CAST(l_quantity AS INTEGER) % 5 AS rating, o_orderdate AS at, o_orderkey, l_linenumber FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)"

C.sql("exclude_test_traffic", "B2", """
SELECT event_type, count(*) AS n FROM {events} WHERE NOT event_type LIKE 'err%' AND user_id NOT IN (0, 1) GROUP BY event_type""")
C.sql("prefix_buckets", "B3", """
SELECT CASE WHEN p_type LIKE 'ECONOMY%' THEN 'economy' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS bucket, count(*) AS n FROM {part} GROUP BY 1""")
C.sql("card_projection", "B4", """
SELECT page_id, coalesce(nullif(EXTRACT(url, '//([^/]*)/', 1), ''), 'none') AS site, REPLACE_ALL(EXTRACT(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '') AS title FROM {pages}""")
C.sql("effective_label", "B5 D2 H28", """
SELECT coalesce(nullif(CASE WHEN value > 50 THEN event_type ELSE '' END, ''), JSON_K(props)) AS label, count(*) AS n FROM {events} GROUP BY 1""")
C.sql("feed_page", "B8 F9", """
SELECT c_custkey, lower(c_name) AS name, c_mktsegment FROM {customer} WHERE lower(c_name) LIKE '%00%' AND c_mktsegment = 'MACHINERY' ORDER BY lower(c_name), c_custkey LIMIT 24 OFFSET 24""")
C.sql("tri_state_counts", "B9 C2", """
SELECT count(*) AS total, count(quality) AS annotated, count(*) - count(quality) AS open, count(*) FILTER (WHERE quality = 1) AS good
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")
C.sql("ttl_filter", "B10 B11 D5", """
SELECT user_id, max(ts) AS latest, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-02-09 00:00:00' GROUP BY user_id""")
C.sql("liked_level_guard", "B21", f"""
WITH liked AS (SELECT r.profile, p.p_type AS level, count(*) AS n FROM {_RATED} r JOIN {{part}} p ON p.p_partkey = r.item WHERE r.rating >= 4 GROUP BY 1, 2),
total AS (SELECT profile, CAST(sum(n) AS BIGINT) AS evidence FROM liked GROUP BY profile),
levels AS (SELECT DISTINCT p_type AS level FROM {{part}})
SELECT t.profile, v.level, CASE WHEN t.evidence >= 2 AND l.level IS NULL THEN 1.0e0 ELSE 0.0e0 END AS penalty
FROM total t CROSS JOIN levels v LEFT JOIN liked l ON l.profile = t.profile AND l.level = v.level""")
C.sql("pair_membership", "B22 C7", """
SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} l WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus)""")
C.sql("genuine_scans", "B23", """
SELECT DISTINCT user_id, JSON_K(props) AS item FROM {events} WHERE event_type = 'view' AND NOT MATCHES(JSON_K(props), '^(1|2)$') AND JSON_K(props) IS NOT NULL""")
C.sql("scan_join", "C1 C8", """
SELECT o_orderkey, c_mktsegment, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""")
C.sql("exists_flag", "C7", """
SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P') AS pending FROM {customer}""")
C.sql("meta_join", "C3 C4", """
SELECT s.s_suppkey, count(l.l_orderkey) AS n, count(DISTINCT l.l_partkey) AS items FROM {supplier} s LEFT JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' GROUP BY s.s_suppkey""")
C.sql("discussion_rows", "C5 E12", """
SELECT m.conv_id, m.turn, m.role, coalesce(r.role, 'none') AS reply_to, length(m.text) AS chars
FROM {conversations} m LEFT JOIN {conversations} r ON r.conv_id = m.conv_id AND r.turn = m.turn - 1
ORDER BY m.conv_id DESC, m.turn DESC LIMIT 51""")
C.sql("left_on_predicate", "C9 F6", """
SELECT p_partkey, count(DISTINCT o.o_custkey) AS saves FROM {part} LEFT JOIN {lineitem} l ON l.l_partkey = p_partkey AND l.l_quantity > 45 LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'O'
GROUP BY p_partkey ORDER BY saves DESC, p_partkey LIMIT 50""")
C.sql("distinct_savers", "C10 D6", """
SELECT s_nationkey, count(DISTINCT o_custkey) AS savers FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {customer} ON c_custkey = o_custkey AND c_nationkey <> s_nationkey
GROUP BY s_nationkey""")
C.sql("same_hash_other_key", "C11 G7", """
WITH h AS (SELECT doc_id, source, SHA(lower(text)) AS h FROM {documents})
SELECT h, count(*) AS files, count(DISTINCT source) AS keys FROM h GROUP BY h HAVING count(DISTINCT source) > 1""")
C.sql("cards_lookup", "C12", """
SELECT l_orderkey, l_linenumber, p_name, s_name, n_name FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey""")
C.sql("paired_predictions", "C20 D17", """
WITH a AS (SELECT l_orderkey AS q, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS ok FROM {lineitem} GROUP BY 1),
b AS (SELECT o_orderkey AS q, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS ok FROM {orders}),
c AS (SELECT count(*) FILTER (WHERE a.ok = 0 AND b.ok = 1) AS fixed, count(*) FILTER (WHERE a.ok = 1 AND b.ok = 0) AS broken, count(*) AS n FROM a JOIN b ON a.q = b.q)
SELECT fixed, broken, n, round(2 * sqrt(fixed + broken), 6) AS threshold, CASE WHEN abs(fixed - broken) > 2 * sqrt(fixed + broken) THEN 'significant' ELSE 'noise' END AS verdict FROM c""")
C.sql("restricted_rank", "C21", """
SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rank FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 48)""")
C.sql("label_corrections", "C25", """
SELECT CASE WHEN l.toxic = 1 THEN 'exclude' WHEN l.quality = 0 THEN 'relabel' ELSE 'keep' END AS action, coalesce(CASE WHEN l.quality = 0 THEN 'low' END, d.lang) AS slug, count(*) AS n
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) <> 1 AND NOT EXISTS (SELECT 1 FROM {benchmark} b WHERE b.item_id = d.doc_id) GROUP BY 1, 2""")
C.sql("rating_aggregates", "D1", f"""
SELECT item, round(avg(rating), 2) AS rating, count(*) AS n FROM {_RATED} r WHERE rating > 1 GROUP BY item""")
C.sql("conditional_pivot", "D4", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {events} u WHERE u.event_type = 'error' AND u.event_id = e.event_id + 1 AND u.user_id = e.user_id) GROUP BY user_id""")
C.sql("duplicate_statistics", "D9", """
WITH h AS (SELECT SHA(text) AS h, source, length(text) AS bytes FROM {documents}),
scoped AS (SELECT 'all' AS scope, h, source, bytes FROM h UNION ALL SELECT source AS scope, h, source, bytes FROM h),
g AS (SELECT scope, h, count(*) AS n, count(DISTINCT source) AS keys, sum(bytes) AS s, max(bytes) AS m FROM scoped GROUP BY scope, h)
SELECT scope, CAST(sum(n) AS BIGINT) AS files, count(*) AS unique_files, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) FILTER (WHERE keys > 1) AS cross_key, CAST(sum(s - m) AS BIGINT) AS redundant FROM g GROUP BY scope""")
C.sql("group_records", "D10", """
WITH d AS (SELECT SHA(text) AS h, doc_id FROM {documents}), g AS (SELECT h, count(*) AS n FROM d GROUP BY h HAVING count(*) > 1)
SELECT d.h, g.n, CAST(d.doc_id + 1000000 AS VARCHAR(20)) AS member FROM d JOIN g ON g.h = d.h""")
C.sql("macro_accuracy", "D13 D15", """
SELECT round(avg(acc), 6) AS macro, count(*) AS classes FROM (SELECT lang, avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang) x""")
C.sql("accuracy_modulo_group", "D16", """
WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS grp FROM {part})
SELECT count(*) AS n, count(*) FILTER (WHERE l.l_partkey = s.p_partkey) AS exact, count(*) FILTER (WHERE g.grp = h.grp) AS by_group
FROM {lineitem} l JOIN g ON g.p_partkey = l.l_partkey JOIN {part} s ON s.p_partkey = l.l_suppkey * 7 % 100 JOIN g h ON h.p_partkey = s.p_partkey""")
C.sql("pearson_jaccard", "D21", """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) * 1.0e0 / count(*) FILTER (WHERE l_quantity > 25 OR l_discount > 0.05), 6) AS jaccard FROM {lineitem}""")
C.sql("bayes_prior", "D24", f"""
WITH t AS (SELECT item, avg(rating) AS a, count(*) AS n FROM {_RATED} r GROUP BY item), m AS (SELECT avg(rating) AS mu FROM {_RATED} r), x AS (SELECT max(n) AS most FROM t)
SELECT item, round((a * n + 3 * mu) / (n + 3), 6) AS shrunk, round(ln(1 + n) / ln(1 + most), 6) AS popularity FROM t CROSS JOIN m CROSS JOIN x""")
C.sql("taste_passport", "D26 J17", f"""
WITH s AS (SELECT r.profile, p.p_type AS style, sum(r.rating) AS w FROM {_RATED} r JOIN {{part}} p ON p.p_partkey = r.item WHERE r.rating >= 4 GROUP BY 1, 2),
t AS (SELECT profile, style, w, sum(w) OVER (PARTITION BY profile) AS total, row_number() OVER (PARTITION BY profile ORDER BY w DESC, style) AS rn FROM s)
SELECT profile, style, round(w * 1.0e0 / total, 6) AS share, CAST(rn AS BIGINT) AS rank FROM t WHERE rn <= 3""")
C.sql("threshold_sweep", "D27", """
WITH t AS (SELECT 0.1 * i AS thr FROM EACH(RANGE_LIST(0, 9)) AS g(i))
SELECT CAST(round(thr, 1) AS DOUBLE) AS threshold, count(*) FILTER (WHERE l_discount * 10 < thr) AS rejected, count(*) FILTER (WHERE l_discount * 10 >= thr AND l_returnflag = 'R') AS lost FROM {lineitem} CROSS JOIN t GROUP BY 1""".replace("FROM EACH(RANGE_LIST(0, 9)) AS g(i)", "FROM (SELECT 1 AS one) o, EACH(RANGE_LIST(0, 9)) AS g(i)"))
C.sql("mean_rank_gap", "D29", """
WITH r AS (SELECT l_orderkey AS q, l_quantity AS s, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS rk, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS nx FROM {lineitem})
SELECT round(avg(CASE WHEN f = 'R' THEN rk END), 6) AS mean_rank, round(avg(CASE WHEN rk = 1 THEN s - nx END), 6) AS mean_gap, round(avg(CASE WHEN rk = 1 AND f = 'A' THEN 1.0e0 ELSE 0.0e0 END), 6) AS confused FROM r""")
C.sql("dimension_progress", "D30", f"""
SELECT r.profile, least(count(DISTINCT r.item), 10) AS items, least(count(DISTINCT p.p_brand), 5) AS brands, least(count(DISTINCT p.p_type), 3) AS styles FROM {_RATED} r JOIN {{part}} p ON p.p_partkey = r.item GROUP BY r.profile""")
C.sql("histogram_buckets", "D31", """
WITH c AS (SELECT p_partkey, count(l_orderkey) AS n FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS items FROM c GROUP BY 1""")
C.sql("last_event_of_kind", "D33 K1", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn = 1""")
C.sql("batch_progress", "D34", """
SELECT o_orderkey, count(*) AS parts, count(*) FILTER (WHERE l_linestatus = 'F') AS done, round(count(*) FILTER (WHERE l_linestatus = 'F') * 1.0e0 / count(*), 6) AS progress FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
C.sql("match_method_share", "D37", """
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey IN (SELECT s_suppkey FROM {supplier}) THEN 'column' WHEN p_size < 10 THEN 'exact' WHEN p_size < 40 THEN 'fuzzy' ELSE 'unresolved' END AS method FROM {part})
SELECT method, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM m GROUP BY method""")
C.sql("any_of_accuracy", "D38", """
WITH q AS (SELECT o.o_orderkey, bool_or(l.l_returnflag = 'R') AS hit, count(l.l_orderkey) AS n FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 30 GROUP BY o.o_orderkey)
SELECT count(*) AS queries, count(*) FILTER (WHERE coalesce(hit, false)) AS hits, count(*) FILTER (WHERE n = 0) AS fallback FROM q""")
C.sql("ambiguity_groups", "D41", """
WITH t AS (SELECT p_partkey, p_brand, JOINED(SORTED_ITEMS(DISTINCT_ITEMS(WORDS(lower(p_name)))), ' ') AS tokens FROM {part})
SELECT p_brand, tokens, count(*) AS n, min(p_partkey) AS first_item FROM t GROUP BY p_brand, tokens HAVING count(*) > 1""")


@C.query("filtered_page", "B1", """
WITH f AS (SELECT p_partkey, p_name FROM part WHERE p_size >= 5 AND (p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%'))
SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 20 OFFSET 10""")
def filtered_page(spark, sf_dir, word="red", limit=20, offset=10):
    """A page of what passes the filters that are given, with their total."""
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.ilike(F.col(c), F.lit(f"%{word}%"))
    found = table(spark, sf_dir, "part").where((F.col("p_size") >= 5) & hit)
    page = found.orderBy("p_partkey").offset(offset).limit(limit)
    return page.select("p_partkey", "p_name").crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def _rated(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("profile"), F.col("l_partkey").alias("item"), (1 + F.col("l_quantity").cast("int") % 5).alias("rating"))


@C.query("popularity_topn", "D3 F1", """
SELECT l_partkey AS item, count(*) AS n, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey ORDER BY n DESC, item LIMIT 30""")
def popularity_topn(spark, sf_dir, n=30):
    """The most used items, with the total of all."""
    counted = _rated(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    first = counted.orderBy(F.desc("n"), "item").limit(n)
    return first.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total"))))  # one row


@C.query("percentiles", "D18", """
WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT k, round(quantile_cont(v, 0.95), 4) AS linear, max(v) FILTER (WHERE i = floor(0.95 * (n - 1))) AS by_index, max(v) FILTER (WHERE i = least(floor(0.95 * n), n - 1)) AS by_count FROM r GROUP BY k""")
def percentiles(spark, sf_dir):
    """The 95th percentile of prices by flag, by three conventions."""
    found = ordering.percentiles(table(spark, sf_dir, "lineitem"), key="l_returnflag", value="l_extendedprice", ties=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], q=0.95)
    return found.select(F.col("l_returnflag").alias("k"), F.round("linear", 4).alias("linear"), "by_index", "by_count")


@C.query("unseen_items", "C6", """
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND l_quantity::INTEGER % 5 = 0 AND o_custkey % 7 = 3)""")
def unseen_items(spark, sf_dir):
    """Items that none of a group of profiles has given the lowest rating."""
    low = _rated(spark, sf_dir).where("rating = 1 and profile % 7 = 3").select(F.col("item").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(low, "p_partkey", "left_anti").select("p_partkey")


@C.query("visible_rows", "B17", """
SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'own' ELSE 'public' END AS access FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 7""")
def visible_rows(spark, sf_dir, viewer=7):
    """What a viewer may see: public rows and its own."""
    return ledger.visible(table(spark, sf_dir, "orders"), owner="o_custkey", public=F.col("o_orderstatus") == "F", viewer=viewer).select("o_orderkey", "access")


@C.query("contract_violations", "B18", """
WITH a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS places, max(l_linenumber) AS last, bool_and(isfinite(l_discount) AND l_discount BETWEEN 0 AND 1) AS fine, bool_and(l_tax BETWEEN 0 AND 0.05) AS low FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(',', CASE WHEN n NOT BETWEEN 2 AND 6 THEN 'count' END, CASE WHEN places <> n OR last <> n THEN 'places' END, CASE WHEN NOT fine THEN 'score' END, CASE WHEN NOT low THEN 'gap' END) AS violations FROM a WHERE n NOT BETWEEN 2 AND 6 OR places <> n OR last <> n OR NOT fine OR NOT low""")
def contract_violations(spark, sf_dir):
    """Responses (orders with their lines as alternatives) that break the contract: counts, places, finite scores in range."""
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_discount").alias("score"), F.col("l_tax").alias("gap"))
    found = ledger.contract_violations(answers, least=2, most=6, ranges={"score": (0.0, 1.0), "gap": (0.0, 0.05)})
    return found.select(F.col("id").alias("l_orderkey"), F.array_join("violations", ",").alias("violations"))


@C.query("role_by_rules", "B13", """
WITH d AS (SELECT l_partkey AS item, arg_max(CASE WHEN l_quantity > 25 THEN 'front' ELSE 'rejected' END, struct_pack(o := l_orderkey, l := l_linenumber, s := l_suppkey, e := l_extendedprice, q := l_quantity)) AS role FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09 GROUP BY l_partkey)
SELECT p_partkey, coalesce(role, CASE WHEN regexp_matches(p_name, '(ring|widget)$') THEN 'front' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' ELSE 'other' END) AS role FROM part LEFT JOIN d ON item = p_partkey""")
def role_by_rules(spark, sf_dir):
    """Roles by patterns of the name unless a reviewer decided; the last decision holds."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.09")
    last = F.max_by(F.when(F.col("l_quantity") > 25, "front").otherwise("rejected"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"))
    decided = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(last.alias("decided"))
    return ledger.roles(table(spark, sf_dir, "part"), decided, key="p_partkey", text="p_name", rules=[("(ring|widget)$", "front"), ("^(red|blue)", "colour")], other="other")


@C.query("folder_detail", "C26 C11", """
WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT h, list_sort(list(DISTINCT source)) AS keys FROM h WHERE source IS NOT NULL GROUP BY h)
SELECT doc_id, h.source, quality, toxic, array_to_string(list_filter(keys, lambda x: x <> h.source), ',') AS elsewhere FROM h JOIN k USING (h) LEFT JOIN labels USING (doc_id)""")
def folder_detail(spark, sf_dir):
    """Members of every folder with their labels and the other folders that hold the same bytes."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    keys = docs.where("source is not null").groupBy("h").agg(F.sort_array(F.collect_set("source")).alias("keys"))
    rows = docs.join(keys, "h").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", "source", "quality", "toxic", F.array_join(F.filter("keys", lambda x: x != F.col("source")), ",").alias("elsewhere"))


@C.query("dataset_stats", "D8", """
SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE lang = 'en') AS english, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents""")
def dataset_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@C.query("attempt_counts", "D36", "SELECT user_id AS source, event_type AS status, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2")
def attempt_counts(spark, sf_dir):
    """Attempts by source and status, with their share of the source."""
    counted = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@C.query("coverage_report", "D7 A16", """
SELECT p_partkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(*) FILTER (WHERE l_returnflag = 'N') AS pending, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS done,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted, coalesce(round(sum(l_quantity), 2), 0.0) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def coverage_report(spark, sf_dir):
    """Seven conditional counts of every catalogue row, rows without any included."""
    is_ = lambda c, v: F.col(c) == v
    counts = {"returned": is_("l_returnflag", "R"), "accepted": is_("l_returnflag", "A"), "pending": is_("l_returnflag", "N"), "open": is_("l_linestatus", "O"), "done": is_("l_linestatus", "F"), "discounted": F.col("l_discount") > 0.05}
    return ledger.coverage(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").withColumn("p_partkey", F.col("l_partkey")), key="p_partkey", counts=counts, sums={"quantity": F.round(F.sum("l_quantity"), 2)})


@C.query("export_summary", "D35 A16", """
SELECT count(DISTINCT d.source) AS folders, count(DISTINCT d.source) FILTER (WHERE d.n_chars > 0) AS filled, sum(octet_length(encode(d.text)))::BIGINT AS bytes, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.quality = 0) AS bad, count(*) FILTER (WHERE l.quality IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def export_summary(spark, sf_dir):
    """What an export holds: folders, those with content, bytes and the split of labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count_distinct("source").alias("folders"), F.count_distinct(F.when(F.col("n_chars") > 0, F.col("source"))).alias("filled"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@C.query("seed_counts", "D42", """
SELECT s_suppkey, count(DISTINCT p_partkey) AS items, count(DISTINCT l_orderkey) AS lists, count(*) FILTER (WHERE p_type = 'PROMO') AS promoted FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey < 12 GROUP BY s_suppkey""")
def seed_counts(spark, sf_dir):
    """Items, lists and promoted members of each public owner, from one joined set."""
    rows = table(spark, sf_dir, "supplier").where("s_nationkey < 12").join(table(spark, sf_dir, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("s_suppkey").agg(F.count_distinct("p_partkey").alias("items"), F.count_distinct("l_orderkey").alias("lists"), F.count_if(F.col("p_type") == "PROMO").alias("promoted"))


@C.query("collection_counters", "D39 G6", """
WITH l AS (SELECT o_custkey AS profile, l_partkey AS item, l_returnflag AS f, l_linestatus AS s, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT DISTINCT profile, item FROM l WHERE q > 45), o AS (SELECT profile, item, sum(q)::BIGINT AS bottles FROM l WHERE f = 'N' AND s = 'O' GROUP BY 1, 2), t AS (SELECT DISTINCT profile, item FROM l WHERE f = 'A'),
k AS (SELECT profile, item FROM w UNION SELECT profile, item FROM o UNION SELECT profile, item FROM t)
SELECT k.profile, count(*) AS all_items, count(w.item) AS wished, count(o.item) AS owned, count(t.item) AS tried, coalesce(sum(bottles), 0)::BIGINT AS bottles FROM k LEFT JOIN w USING (profile, item) LEFT JOIN o USING (profile, item) LEFT JOIN t USING (profile, item) GROUP BY k.profile""")
def collection_counters(spark, sf_dir):
    """Five counters of each collection over the union of all keys that it touches."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("profile"), F.col("l_partkey").alias("item"), "l_returnflag", "l_linestatus", "l_quantity")
    kept = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.col("l_quantity"))
    return ledger.collection_counters(rows, wished=F.col("l_quantity") > 45, bottles=kept, tried=F.col("l_returnflag") == "A")


@C.query("kind_tabs", "B19", """
WITH k AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'sparkling' WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'blue %' THEN 'white' END AS kind FROM part)
SELECT kind, p_partkey FROM k WHERE kind IS NOT NULL""")
def kind_tabs(spark, sf_dir):
    """Items by tab: sparkling before colour; those of no tab are left out."""
    color = F.split("p_name", " ")[0]
    kind = F.when(F.col("p_type") == "PROMO", "sparkling").when(color == "red", "red").when(color == "blue", "white")
    return table(spark, sf_dir, "part").select(kind.alias("kind"), "p_partkey").where("kind is not null")
