"""Text: normal forms, tokens, rarity, similarity, matching, duplicates and leaks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import cues, entity, graph, matching, text_index
from larkspur.plans.shared import Catalogue, translate
from larkspur.sources import annotations
from larkspur.storage import materialize, table

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS

_TOKENS = "SELECT d.doc_id, x.w FROM (SELECT doc_id, DISTINCT_ITEMS(WORDS(REPLACE_ALL(lower(left(text, 2000)), '[^a-zà-ÿ0-9]+', ' '))) AS ws FROM {documents}) d, EACH(ws) AS x(w)".replace("left(text, 2000)", "text")

C.sql("normal_forms", "H1 H2", """
SELECT doc_id, SHA(trim(REPLACE_ALL(replace(lower(text), 'ß', 'ss'), '[^a-zà-ÿ0-9]+', ' '))) AS collapsed, SHA(REPLACE_ALL(lower(text), '[^a-zà-ÿ0-9 ]', '')) AS spaced, SHA(REPLACE_ALL(replace(lower(text), ',', '.'), '[^a-z0-9. ]+', ' ')) AS ocr FROM {documents}""")
C.sql("html_strip", "H2", """
SELECT page_id, length(REPLACE_ALL(html, '<[^>]*>', '')) AS chars, EXTRACT(html, '<h1>([^<]*)</h1>', 1) AS heading, EXTRACT(html, 'lang="([a-z]+)"', 1) AS lang FROM {pages}""")
C.sql("first_number", "H4", """
SELECT event_id, TRY_DOUBLE(replace(EXTRACT(props, '([0-9]+([.,][0-9]+)?)', 1), ',', '.')) AS number FROM {events}""")
C.sql("duplicate_key", "H5 C11", """
SELECT REPLACE_ALL(lower(concat_ws(' ', p_brand, p_name)), '[0-9%#]+', '') AS k, count(*) AS n, min(p_partkey) AS first_item FROM {part} GROUP BY 1""")
C.sql("stable_jitter", "H18", """
SELECT p_partkey, round(HEX_BYTE(left(SHA(concat('feed:', CAST(p_partkey AS VARCHAR(20)))), 2)) / 255, 6) AS jitter FROM {part}""")
C.sql("idf_terms", "D22", f"""
WITH t AS ({_TOKENS}), n AS (SELECT count(*) AS docs FROM {{documents}}), f AS (SELECT CASE WHEN length(w) > 5 THEN left(w, 5) ELSE w END AS stem, count(DISTINCT doc_id) AS df FROM t GROUP BY 1)
SELECT stem, df, round(ln(docs * 1.0e0 / df), 6) AS idf FROM f CROSS JOIN n WHERE df >= 2 AND df <= 0.25 * docs""")
C.sql("leak_check", "G5", """
WITH h AS (SELECT doc_id, source, SHA(text) AS exact, SHA(REPLACE_ALL(lower(text), '[^a-zà-ÿ0-9]+', ' ')) AS normal FROM {documents}),
e AS (SELECT exact FROM h GROUP BY exact HAVING count(DISTINCT source) > 1), n AS (SELECT normal FROM h GROUP BY normal HAVING count(DISTINCT source) > 1)
SELECT h.source, count(e.exact) AS exact_leaks, count(n.normal) AS normal_leaks FROM h LEFT JOIN e ON e.exact = h.exact LEFT JOIN n ON n.normal = h.normal GROUP BY h.source""")

@C.query("tfidf_neighbours", "C14 J2 J25", f"""
WITH t AS ({_TOKENS}), n AS (SELECT count(*) AS docs FROM {{documents}}), f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
x AS (SELECT t.doc_id, t.w, ln(docs * 1.0e0 / df) AS v FROM t JOIN f ON f.w = t.w CROSS JOIN n WHERE df >= 2 AND df <= 0.25 * docs),
l AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM x GROUP BY doc_id),
s AS (SELECT a.doc_id AS q, b.doc_id AS d, sum(a.v * b.v) AS dot FROM x a JOIN x b ON a.w = b.w AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2),
c AS (SELECT q, d, round(dot / (la.len * lb.len), 5) AS sim FROM s JOIN l la ON la.doc_id = q JOIN l lb ON lb.doc_id = d)
SELECT q, d, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rn FROM c) y WHERE rn <= 5""")
def tfidf_neighbours(spark, sf_dir):
    """The 5 documents nearest to each one whose id divides by 50, by words in at most a quarter of the documents."""
    docs = table(spark, sf_dir, "documents")
    tokens = spark.sql(translate(_TOKENS, 0), documents=docs)
    n = docs.count()
    words = tokens.groupBy("w").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= 0.25 * n))
    words = materialize(words.select("w", F.monotonically_increasing_id().alias("term"), F.log(n / F.col("df")).alias("v")), "words")
    held = tokens.join(words, "w").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("term").alias("terms"), F.collect_list("v").alias("values"))
    return matching.sparse_topk(materialize(held, "weights"), k=5, asked="id % 50 = 0").withColumnRenamed("id", "d")


C.sql("stem_mode", "H3 D23", f"""
WITH t AS ({_TOKENS}), s AS (SELECT left(w, 5) AS stem, w, count(*) AS n FROM t WHERE length(w) > 5 GROUP BY 1, 2)
SELECT stem, w AS spelling, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, w) AS rn FROM s) x WHERE rn = 1""")


def _nested(inner: str, form: str, table: dict[str, str]) -> str:
    """SQL that applies a replacement for each entry of a table, in order."""
    for old, new in table.items():
        inner = form.format(inner, old, new)
    return inner


@C.query("six_normal_forms", "H1 H11", rf"""
SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^а-яa-z0-9]+', ' ', 'g'), ' ')) AS collapsed, sha256(regexp_replace(lower(text), '[^а-яa-z0-9 ]+', ' ', 'g')) AS spaced,
  sha256(trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' ')) AS words,
  sha256(trim(regexp_replace({_nested("lower(nfc_normalize(text))", "replace({0}, '{1}', '{2}')", T.TRANSLATED_PHRASES)}, '[^a-zа-я0-9]+', ' ', 'g'), ' ')) AS translated,
  sha256(trim(regexp_replace({_nested("lower(strip_accents(text))", "regexp_replace({0}, '" + chr(92) + "b{1}" + chr(92) + "b', '{2}', 'g')", T.FOLDED_WORDS)}, '[^a-z0-9]+', ' ', 'g'), ' ')) AS folded,
  sha256(trim(regexp_replace(replace(lower(text), ',', '.'), '[^а-яa-z0-9.]+', ' ', 'g'), ' ')) AS ocr FROM documents""")
def six_normal_forms(spark, sf_dir):
    """Six comparable forms of a text; they are for different sources and not interchangeable."""
    t = F.col("text")
    forms = {"collapsed": T.collapsed(t), "spaced": T.spaced(t), "words": T.word_form(t), "translated": T.translated(t, T.TRANSLATED_PHRASES), "folded": T.folded(t, T.FOLDED_WORDS), "ocr": T.ocr_form(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in forms.items()])


@C.query("transliterated", "H11", """
WITH m(a, b) AS (VALUES ('щука', 'schuka'), ('хлеб', 'hleb'), ('йод', 'yod'), ('объезд', 'obezd'), ('жюри', 'zhyuri'), ('цвет', 'tsvet'), ('ёж', 'ezh'), ('чай', 'chay'), ('ширь', 'shir'), ('эхо', 'eho'))
SELECT p_partkey, b || '-' || lower(p_name) AS latin FROM part JOIN m ON a = ['щука', 'хлеб', 'йод', 'объезд', 'жюри', 'цвет', 'ёж', 'чай', 'ширь', 'эхо'][p_size % 10 + 1]""")
def transliterated(spark, sf_dir):
    """Names with a Cyrillic word in front, in Latin letters."""
    words = F.array(*map(F.lit, ("щука", "хлеб", "йод", "объезд", "жюри", "цвет", "ёж", "чай", "ширь", "эхо")))
    return table(spark, sf_dir, "part").select("p_partkey", T.transliterate(F.concat(F.get(words, F.col("p_size") % 10), F.lit("-"), F.col("p_name"))).alias("latin"))


@C.query("style_triple", "H6", """
SELECT p_partkey, coalesce(list_filter(['red', 'blue', 'green'], lambda c: contains(lower(p_type), c))[1], list_filter(['red', 'blue', 'green'], lambda c: contains(p_name, c))[1], '') AS color,
  CASE WHEN p_size < 10 THEN 'dry' WHEN p_size < 25 THEN 'semi' ELSE 'sweet' END AS level, starts_with(p_type, 'PROMO') AS sparkling FROM part""")
def style_triple(spark, sf_dir):
    """Colour by priority, of the category first and of the name otherwise; level; sparkling."""
    first = lambda c: F.get(F.filter(F.array(*map(F.lit, ("red", "blue", "green"))), lambda r: F.contains(c, r)), F.lit(0))
    level = F.when(F.col("p_size") < 10, "dry").when(F.col("p_size") < 25, "semi").otherwise("sweet")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(first(F.lower("p_type")), first(F.col("p_name")), F.lit("")).alias("color"), level.alias("level"), F.startswith("p_type", F.lit("PROMO")).alias("sparkling"))


@C.query("grape_lists", "H7", """
WITH g AS (SELECT p_partkey, string_split(replace(p_name, ' ', ', ') || ', Blend,' || lower(p_type), ',') AS parts FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(parts, lambda x: lower(trim(x))), lambda x: x <> '' AND x NOT IN ('blend', 'promo')), '|') AS grapes FROM g""")
def grape_lists(spark, sf_dir):
    """Comma lists split and trimmed, placeholders removed."""
    told = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", Blend,"), F.lower("p_type"))
    grapes = F.filter(F.transform(F.split(told, ","), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~x.isin("blend", "promo"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(grapes, "|").alias("grapes"))


@C.query("name_tokens", "H8", r"""
WITH n AS (SELECT p_partkey, p_name || ' the ' || p_type || ' ' || (p_size / 10.0)::DECIMAL(5,1) || ' l ' || (1970 + p_size) || ' ' || p_size % 10 AS t FROM part),
c AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\b\d+([.,]\d+)?\s*(ml|l|litre)\b', ' ', 'g'), '\b(19|20)\d{2}\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM n)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: w NOT IN ('the', 'promo') AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$'))))), '|') AS tokens FROM c""")
def name_tokens(spark, sf_dir):
    """Tokens of product names without volumes, years and stop words."""
    name = F.concat_ws(" ", "p_name", F.lit("the"), "p_type", (F.col("p_size") / 10.0).cast("decimal(5,1)").cast("string"), F.lit("l"), (1970 + F.col("p_size")).cast("string"), (F.col("p_size") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.name_tokens(name, ["the", "promo"])), "|").alias("tokens"))


SLUG_COLORS, SLUG_SWEET = ["red", "blue", "green", "hot", "cold"], ["dry", "semi", "sweet", "brut"]
_SLUGS = """slugs AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 = 0 THEN (1975 + p_size)::VARCHAR END, string_split(p_name, ' ')[2], CASE WHEN p_size % 3 = 0 THEN 'brut' END, CASE WHEN p_size % 6 = 0 THEN 'sparkling' END, string_split(p_name, ' ')[1], CASE WHEN p_size % 5 = 0 THEN 'semi' END, CASE WHEN p_size % 2 = 0 THEN 'dry' END, (p_size % 17)::VARCHAR], lambda x: x IS NOT NULL), '-') AS slug FROM part)"""


@C.query("slug_fields", "H9", f"""
WITH {_SLUGS}, t AS (SELECT p_partkey, slug, string_split(slug, '-') AS w FROM slugs), i AS (SELECT *, list_max(list_transform(generate_series(1, len(w)), lambda k: CASE WHEN w[k] IN ('red', 'blue', 'green', 'hot', 'cold') THEN k END)) AS pos FROM t),
s AS (SELECT *, list_filter(list_slice(w, pos + 1, len(w)), lambda x: x IN ('dry', 'semi', 'sweet', 'brut')) AS behind, list_filter(list_slice(w, greatest(1, pos - 2), pos - 1), lambda x: x IN ('dry', 'semi', 'sweet', 'brut')) AS ahead FROM i)
SELECT p_partkey, slug, list_filter(w, lambda x: regexp_matches(x, '^(19|20)[0-9][0-9]$'))[1] AS year, w[pos] AS color, CASE WHEN pos IS NULL THEN '' ELSE array_to_string(list_concat(behind, list_filter(ahead, lambda x: NOT list_contains(behind, x))), '|') END AS sweetness,
  CASE WHEN pos IS NULL THEN '' ELSE array_to_string(list_filter(list_slice(w, pos + 1, len(w)), lambda x: regexp_matches(x, '^[0-9]{{1,3}}$')), '|') END AS strength FROM s""")
def slug_fields(spark, sf_dir):
    """Year, colour, sweetness and strength read from dashed slugs."""
    when = lambda n, v: F.when(F.col("p_size") % n == 0, v)
    word = F.split("p_name", " ")
    slug = F.concat_ws("-", when(4, (1975 + F.col("p_size")).cast("string")), word[1], when(3, "brut"), when(6, "sparkling"), word[0], when(5, "semi"), when(2, "dry"), (F.col("p_size") % 17).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug")).withColumn("p", T.parsed_slug(F.col("slug"), SLUG_COLORS, SLUG_SWEET))
    return rows.select("p_partkey", "slug", "p.year", "p.color", F.array_join("p.sweetness", "|").alias("sweetness"), F.array_join("p.strength", "|").alias("strength"))


@C.query("file_names", "H12 B16 H10", r"""
WITH f AS (SELECT p_partkey, ['thumbnail_', 'small_', '', 'large_'][p_size % 4 + 1] || replace(p_name, ' ', '_') || '_' || left(md5(p_partkey::VARCHAR), 10) || ['.webp', '.JPG', '.txt'][p_size % 3 + 1] AS name FROM part)
SELECT p_partkey, name, regexp_replace(regexp_replace(name, '^(thumbnail_|small_|medium_|large_)', ''), '_[0-9a-f]{10}\.(webp|jpg|jpeg|png)$', '', 'i') AS base, CASE WHEN name ILIKE '%.webp' OR name ILIKE '%.jpg' THEN CASE WHEN starts_with(name, 'thumbnail_') THEN 'thumbnail' ELSE 'photo' END ELSE 'other' END AS kind FROM f""")
def file_names(spark, sf_dir):
    """Base and kind of upload names."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.col("p_size") % n)
    name = F.concat(pick(("thumbnail_", "small_", "", "large_"), 4), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.left(F.md5(F.col("p_partkey").cast("string")), F.lit(10)), pick((".webp", ".JPG", ".txt"), 3))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    image = F.lower("name").rlike(r"\.(webp|jpg)$")
    kind = F.when(~image, "other").when(F.startswith("name", F.lit("thumbnail_")), "thumbnail").otherwise("photo")
    return rows.select("p_partkey", "name", T.file_base(F.col("name")).alias("base"), kind.alias("kind"))


C.sql("rerank_target", "H10", """
SELECT s_suppkey, concat_ws(' ', s_name, nullif(n_name, ''), CASE WHEN s_acctbal > 5000 THEN 'large' END) AS target, REPLACE_ALL(s_name, '^[^#]*#0*', '') AS base FROM {supplier} LEFT JOIN {nation} ON n_nationkey = s_nationkey""")


@C.query("attribute_features", "H15", r"""
WITH p AS (SELECT p_partkey AS id, p_brand, p_size, string_split(p_name, ' ') AS g, CASE WHEN p_size % 3 > 0 THEN [(1990 + p_size % 8)::VARCHAR] ELSE [] END AS y FROM part),
m AS (SELECT a.id AS a, b.id AS b, a.g AS ag, b.g AS bg, a.y AS ay, b.y AS byy FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id)
SELECT a, b, round(len(list_intersect(ag, bg)) * 1.0 / greatest(1, len(list_distinct(list_concat(ag, bg)))), 6) AS jaccard, (len(list_intersect(ag, bg)) = 0)::INT AS grape_conflict, (len(list_intersect(ay, byy)) > 0)::INT AS year_match, (len(ay) > 0 AND len(byy) > 0 AND len(list_intersect(ay, byy)) = 0)::INT AS year_conflict FROM m""")
def attribute_features(spark, sf_dir):
    """Grape and year agreement of items of one brand and size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.split("p_name", " ").alias("grapes"), T.years_in(F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("of "), (1990 + F.col("p_size") % 8).cast("string"))).otherwise("")).alias("years"))
    return matching.attribute_pairs(rows, blocks=["p_brand", "p_size"])


@C.query("net_votes", "H16", """
WITH c AS (SELECT l_orderkey AS q, l_partkey AS item, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2), t AS (SELECT q, string_split(p_name, ' ') AS text FROM c JOIN part ON p_partkey = item QUALIFY row_number() OVER (PARTITION BY q ORDER BY first, item) = 1),
f AS (SELECT q, item, string_split(p_name, ' ')[1] AS x, string_split(p_name, ' ')[2] AS y FROM c JOIN part ON p_partkey = item),
p AS (SELECT a.q, a.item AS ia, b.item AS ib, CASE WHEN a.x <> b.x THEN list_contains(text, a.x)::INT - list_contains(text, b.x)::INT ELSE 0 END + CASE WHEN a.y <> b.y THEN list_contains(text, a.y)::INT - list_contains(text, b.y)::INT ELSE 0 END AS v FROM f a JOIN f b ON a.q = b.q AND a.item < b.item JOIN t ON t.q = a.q)
SELECT q, item, sum(v)::BIGINT AS votes FROM (SELECT q, ia AS item, v FROM p UNION ALL SELECT q, ib, -v FROM p) GROUP BY q, item""")
def net_votes(spark, sf_dir):
    """Items of an order as candidates of a query that names the first: votes by the fields in which pairs differ."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("w"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("first")).join(part, "item")
    text = held.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("first", "item"))).where("rn = 1").select("q", F.col("w").alias("text"))
    return entity.net_votes(held.join(text, "q").select("q", "item", "text", F.array(F.array(F.col("w")[0]), F.array(F.col("w")[1])).alias("fields")))


@C.query("intent", "H17", """
WITH t AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^a-zà-ÿ0-9]+', ' ', 'g')) || ' ' AS s FROM conversations),
f AS (SELECT *, regexp_matches(s, ' (find|choose|suggest|recommend|want|need|which|best)[a-z]* ') AS choosing, regexp_matches(s, ' (list|set|collection|shelf|table|group)s? ') AS noun, regexp_matches(s, ' (for|with|to|under|on) [a-zà-ÿ]+ ') AS purpose, regexp_matches(s, ' (why|explain|what is|tell) ') AS asks FROM t)
SELECT conv_id, turn, choosing OR (purpose AND NOT asks) AS selection, noun AND (choosing OR purpose) AS collection FROM f""")
def intent(spark, sf_dir):
    """Turns that ask for a selection, and those that ask for a collection."""
    return matching.intents(table(spark, sf_dir, "conversations"))


@C.query("visible_years", "H29", r"""
WITH l AS (SELECT event_id, unnest([{'t': ['since ', 'vintage ', '', 'est. '][event_id % 4 + 1] || (1980 + event_id % 45), 'c': (event_id % 10) / 10.0}, {'t': ' ' || (1985 + event_id % 30) || '.', 'c': 0.9}]) AS x FROM events),
b AS (SELECT event_id, x.c AS c, x.t AS t, trim(x.t, ' -.,:;()[]') AS s FROM l),
y AS (SELECT DISTINCT event_id, regexp_extract(t, '((19|20)[0-9][0-9])', 1) AS y FROM b WHERE c >= 0.5 AND NOT regexp_matches(s, '(?i)(since|est\.?|founded)') AND (regexp_matches(s, '^(19[89][0-9]|20[012][0-9])$') OR regexp_matches(s, '(?i)vintage *(19|20)[0-9][0-9]')))
SELECT e.event_id, coalesce(string_agg(y, ',' ORDER BY y), '') AS years, strftime(any_value(ts), '%Y-%m-%dT%H:%M:%S') AS stamp FROM events e LEFT JOIN y USING (event_id) GROUP BY e.event_id""")
def visible_years(spark, sf_dir):
    """ISO stamps, and years of vintage among recognised lines: sure ones, no founding dates."""
    n = F.col("event_id")
    lines = F.array(
        F.struct(F.concat(F.get(F.array(*map(F.lit, ("since ", "vintage ", "", "est. "))), (n % 4).cast("int")), (1980 + n % 45).cast("string")).alias("text"), ((n % 10) / 10.0).alias("confidence")),
        F.struct(F.concat(F.lit(" "), (1985 + n % 30).cast("string"), F.lit(".")).alias("text"), F.lit(0.9).alias("confidence")),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(T.visible_years(lines)), ",").alias("years"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


@C.query("srcset_choice", "H32", """
WITH c AS (SELECT page_id, unnest([{'s': 320.0 + page_id % 7, 'u': '/a' || page_id}, {'s': 640.0 - page_id % 5 * 100, 'u': '/b' || page_id}, {'s': 1.0, 'u': '/c'}]) AS x FROM pages)
SELECT page_id, arg_max(x.u, struct_pack(s := x.s, u := x.u)) AS url FROM c GROUP BY page_id""")
def srcset_choice(spark, sf_dir):
    """The largest candidate of a srcset."""
    n = F.col("page_id")
    srcset = F.concat(F.lit("/a"), n.cast("string"), F.lit(" "), (320 + n % 7).cast("string"), F.lit("w, /b"), n.cast("string"), F.lit(" "), (640 - n % 5 * 100).cast("string"), F.lit("w, /c"))
    return table(spark, sf_dir, "pages").select("page_id", T.largest_source(srcset).alias("url"))


@C.query("polygons", "H20 H21 A21", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS x0, l_tax AS y0, l_discount + l_quantity / 150 AS x1, l_tax + l_quantity / 100 AS y1, l_suppkey % 5 AS skew FROM lineitem),
p AS (SELECT *, [x0, x1, CASE WHEN skew = 0 THEN x0 ELSE x1 END, CASE WHEN skew = 0 THEN x1 ELSE x0 END] AS xs, [y0, y0, y1, y1] AS ys FROM r),
a AS (SELECT *, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2 AS area FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(area, 8) AS area, skew <> 0 AND area >= 0.00005 AS valid, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM a""")
def polygons(spark, sf_dir):
    """Shoelace area, validity (in bounds of size, corners in order) and centre box of four-cornered outlines; a fifth cross themselves."""
    n, x0, y0 = F.col("l_suppkey") % 5, F.col("l_discount"), F.col("l_tax")
    x1, y1 = x0 + F.col("l_quantity") / 150, y0 + F.col("l_quantity") / 100
    point = lambda x, y: F.array(x, y)
    points = F.array(point(x0, y0), point(x1, y0), point(F.when(n == 0, x0).otherwise(x1), y1), point(F.when(n == 0, x1).otherwise(x0), y1))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", points.alias("points"))
    b = annotations.box(F.col("points"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(annotations.area(F.col("points")), 8).alias("area"), annotations.valid(F.col("points")).alias("valid"), F.round(b["x"] + b["w"] / 2, 6).alias("cx"), F.round(b["y"] + b["h"] / 2, 6).alias("cy"), F.round(b["w"], 6).alias("w"), F.round(b["h"], 6).alias("h"))


@C.query("blocked_match", "C15 C22", """
WITH p AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS ws, p_size % 3 AS sugar, 10 + p_size % 10 / 10.0 AS alcohol, CASE WHEN p_size % 4 = 0 THEN 2000 + p_size END AS year FROM part),
s AS (SELECT a.p_partkey AS target, b.p_partkey AS product, len(list_intersect(a.ws, b.ws)) * 1.0::DOUBLE / len(a.ws) AS coverage, len(list_filter(b.ws, lambda w: NOT list_contains(a.ws, w))) AS extra, abs(a.alcohol - b.alcohol) > 0.2 AS apart, a.year, b.year AS py
  FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND len(list_intersect(a.ws, b.ws)) > 0 AND a.sugar = b.sugar AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year)),
c AS (SELECT *, coverage - 0.025 * extra + CASE WHEN year = py THEN 0.04 ELSE 0 END AS score FROM s WHERE coverage >= 0.65),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 6) DESC, product) AS rn, lead(score) OVER (PARTITION BY target ORDER BY round(score, 6) DESC, product) AS nx FROM c)
SELECT target, product, round(score, 6) AS score, CASE WHEN coverage = 1 AND extra = 0 AND NOT apart AND score >= 0.88 AND round(score - coalesce(nx, 0), 6) >= 0.075 AND (year IS NULL OR year IS NOT DISTINCT FROM py) THEN 'accepted' ELSE 'needs_review' END AS verdict FROM r WHERE rn = 1""")
def blocked_match(spark, sf_dir):
    """The best product of each target inside its producer, by covered name tokens with guards for year, sugar and alcohol."""
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("producer"), F.split("p_name", " ").alias("tokens"), (n % 3).cast("string").alias("sugar"), (10 + n % 10 / 10.0).alias("alcohol"), F.when(n % 4 == 0, 2000 + n).alias("year"))
    return matching.product_match(rows, rows)


@C.query("band_join", "C22", """
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 5.0 AND abs(a.p_size - b.p_size) <= 2""")
def band_join(spark, sf_dir):
    """Items of one brand and type within 5 of price and 2 of size; pairs meet by price band."""
    return matching.band_pairs(table(spark, sf_dir, "part"), key="p_partkey", blocks=["p_brand", "p_type"], bands={"p_retailprice": 5.0, "p_size": 2.0})


@C.query("hash_bands", "C17 H19", """
WITH k AS (SELECT p_partkey AS id, p_brand AS block, sha256(p_name || p_type) AS h, p_size FROM part),
v AS (SELECT id, block, list_transform([0, 1, 2, 3], lambda i: ('0x' || substring(h, 16 * i + 1, 16))::UBIGINT) AS lanes, p_size FROM k), w AS (SELECT id, block, [xor(lanes[1], (1::UBIGINT << (p_size % 20)::UBIGINT) - 1), lanes[2], lanes[3], lanes[4]] AS lanes FROM v),
d AS (SELECT a.block, a.id AS a, b.id AS b, (bit_count(xor(a.lanes[1], b.lanes[1]))::INTEGER + bit_count(xor(a.lanes[2], b.lanes[2]))::INTEGER + bit_count(xor(a.lanes[3], b.lanes[3]))::INTEGER + bit_count(xor(a.lanes[4], b.lanes[4]))::INTEGER)::INTEGER AS distance FROM w a JOIN w b ON a.block = b.block AND a.id < b.id)
SELECT block, a, b, distance, CASE WHEN distance <= 5 THEN 'identical' ELSE 'similar' END AS band FROM d WHERE distance <= 15""")
def hash_bands(spark, sf_dir):
    """Pairs of one brand whose 256-bit hashes differ in at most 5 or 15 bits; up to 19 bits of each hash are flipped by size."""
    lanes = entity.hash_lanes(F.sha2(F.concat("p_name", "p_type"), 256))
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p_size") % 20) - 1
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("id"), F.transform(lanes, lambda x, i: F.when(i == 0, x.bitwiseXOR(flip)).otherwise(x)).alias("lanes"))
    return entity.hash_pairs(rows)


@C.query("cascade_match", "C18 D37 H13")
def cascade_match(spark, sf_dir):
    """Files of small items: by column, by name, by likeness of at least 82, or unresolved."""
    part = table(spark, sf_dir, "part")
    word, brand, size = F.split("p_name", " "), F.translate(F.lower("p_brand"), "#", "_"), F.col("p_size")
    slug = F.concat_ws("_", word[0], word[1], brand)
    bases = part.where("p_size >= 10").select(F.when(size % 2 == 0, slug).otherwise(F.concat_ws("_", word[1], word[0], brand, F.lit("x"))).alias("base"), (size % 7 != 0).alias("usable")).groupBy("base").agg(F.bool_or("usable").alias("usable"))
    bases = bases.withColumn("file_key", T.file_key(F.concat("base", F.lit(".webp"))))
    wanted = part.where("p_size < 10").select(F.col("p_partkey").alias("slug"), slug.alias("key"), F.when(size == 1, T.file_key(F.concat_ws("_", word[1], word[0], brand, F.lit("X.webp")))).alias("photo"))
    return entity.cascade(wanted, bases)


@C.query("fuzzy_names", "C16 H13")
def fuzzy_names(spark, sf_dir):
    """Names of one brand whose sorted tokens are at least 75 % alike by common subsequence, and how alike they are as sets."""
    part = table(spark, sf_dir, "part")
    found = matching.similar_names(part, block="p_brand", key="p_partkey", text="p_name", least=75)
    return found.select("a", "b", "ratio", F.round(entity.token_set_ratio("ta", "tb"), 4).alias("set_ratio"))


@C.query("producer_blocks", "C23", """
WITH p AS (SELECT p_partkey AS product, list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' '))) AS tokens, ' ' || array_to_string(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')), ' ') || ' ' AS text FROM part),
r(producer, aliases, uniq) AS (VALUES ('north', ['red bolt', 'cold ring'], ['red', 'bolt', 'promo']), ('south', ['gear'], ['gear', 'large']), ('west', ['anvil economy'], ['old', 'anvil', 'economy', 'small'])),
m AS (SELECT product, producer, len(list_filter(aliases, lambda a: contains(text, ' ' || a || ' '))) > 0 AS exact, len(list_intersect(uniq, tokens)) * 1.0 / len(uniq) AS share FROM p CROSS JOIN r)
SELECT product, producer, exact::INT AS exact, CASE WHEN share >= 0.5 THEN round(share, 6) ELSE 0 END AS share FROM m WHERE exact OR share >= 0.5""")
def producer_blocks(spark, sf_dir):
    """Producers of a product by an exact alias in its text or by at least half of their unique tokens."""
    tokens = F.concat(F.split("p_name", " "), F.split(F.lower("p_type"), " "))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), tokens.alias("tokens"))
    producers = spark.createDataFrame([("north", ["red bolt", "cold ring"], ["red", "bolt", "promo"]), ("south", ["gear"], ["gear", "large"]), ("west", ["anvil economy"], ["old", "anvil", "economy", "small"])], "producer string, aliases array<string>, unique array<string>")
    return entity.producer_blocks(products, producers)


@C.query("evidence_chain", "B15", f"""
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN [(2000 + p_size % 6)::VARCHAR] ELSE [] END AS years, CASE WHEN p_size % 3 = 0 THEN '' ELSE string_split(p_name, ' ')[1] END AS color, ['dry', 'sweet', ''][p_size % 3 + 1] AS sweet, string_split(p_name, ' ')[2:2] AS grapes,
  CASE p_size % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE '' END AS format, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN lower(p_type) ELSE '' END AS style, list_concat(string_split(p_name, ' '), [lower(p_type)]) AS tokens FROM part),
m AS (SELECT target, product, [CASE WHEN len(a.years) > 0 AND len(b.years) > 0 AND len(list_intersect(a.years, b.years)) = 0 THEN 'year' END, CASE WHEN a.color <> '' AND b.color <> '' AND a.color <> b.color THEN 'color' END, CASE WHEN a.sweet <> '' AND b.sweet <> '' AND a.sweet <> b.sweet THEN 'sweetness' END,
    CASE WHEN len(list_filter(b.grapes, lambda g: NOT list_contains(a.grapes, g))) > 0 THEN 'grape' END, CASE WHEN a.format <> '' AND b.format <> '' AND a.format <> b.format THEN 'format' END, CASE WHEN a.style <> '' AND b.style <> '' AND a.style <> b.style THEN 'style' END,
    CASE WHEN len(list_filter(list_intersect(b.tokens, ['large', 'hot', 'promo']), lambda t: NOT list_contains(a.tokens, t))) > 0 THEN 'critical' END] AS f
  FROM ({ORACLES["blocked_match"]}) JOIN r a ON a.id = target JOIN r b ON b.id = product)
SELECT target, product, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS flags FROM m""")
def evidence_chain(spark, sf_dir):
    """What contradicts the best match of each item inside its producer."""
    n, word = F.col("p_size"), F.split("p_name", " ")
    style = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), F.lower("p_type")).otherwise("")
    empty = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(n % 2 == 0, F.array((2000 + n % 6).cast("string"))).otherwise(empty).alias("years"), F.when(n % 3 == 0, "").otherwise(word[0]).alias("color"), F.get(F.array(F.lit("dry"), F.lit("sweet"), F.lit("")), n % 3).alias("sweet"), F.array(word[1]).alias("grapes"), F.when(n % 5 == 0, "large").when(n % 5 == 1, "small").otherwise("").alias("format"), style.alias("style"), F.concat(word, F.array(F.lower("p_type"))).alias("tokens"))
    matched = materialize(blocked_match(spark, sf_dir).select("target", "product"), "matched")
    pairs = matched.join(rows.alias("a"), F.col("target") == F.col("a.id")).join(rows.alias("b"), F.col("product") == F.col("b.id"))
    flags = entity.conflicts(pairs, sides=("a", "b"), critical=["large", "hot", "promo"])
    return pairs.select("target", "product", F.array_join(flags, ",").alias("flags"))


_CUES = {"body": [("large", 5.0), ("small", 2.0), ("plate", 4.0)], "acidity": [("cold", 4.5), ("hot", 1.5), ("ring", 3.0)]}
_PRIORS = {"bolt": (3.0, 3.5), "gear": (4.0, 2.0), "ring": (2.0, 4.0)}


@C.query("rule_profiles", "H30", """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type = 'PROMO' AS sparkling FROM part),
cues(axis, stem, v) AS (VALUES ('body', 'large', 5.0), ('body', 'small', 2.0), ('body', 'plate', 4.0), ('acidity', 'cold', 4.5), ('acidity', 'hot', 1.5), ('acidity', 'ring', 3.0)),
g(grape, body, acidity) AS (VALUES ('bolt', 3.0, 3.5), ('gear', 4.0, 2.0), ('ring', 2.0, 4.0)),
c AS (SELECT p_partkey, avg(v) FILTER (WHERE axis = 'body') AS b, avg(v) FILTER (WHERE axis = 'acidity') AS a FROM t JOIN cues ON list_contains(w, stem) GROUP BY p_partkey),
p AS (SELECT t.p_partkey, sparkling, coalesce(b, body, 2.5) AS body, coalesce(a, acidity, 3.5) AS acidity FROM t LEFT JOIN c USING (p_partkey) LEFT JOIN g ON list_contains(w, grape))
SELECT p_partkey, (round_even(CASE WHEN sparkling THEN least(body, 3) ELSE body END * 2, 0) / 2)::DOUBLE AS body, (round_even(CASE WHEN sparkling THEN greatest(acidity, 4) ELSE acidity END * 2, 0) / 2)::DOUBLE AS acidity FROM p""")
def rule_profiles(spark, sf_dir):
    """Axes by cue words, else by the grape's prior, else by default; limits of sparkling ones; half steps, halves to even."""
    cues = spark.createDataFrame([(a, s, v) for a, held in _CUES.items() for s, v in held], "axis string, stem string, v double")
    priors = spark.createDataFrame([(g, a, v) for g, held in _PRIORS.items() for a, v in zip(("body", "acidity"), held, strict=True)], "grape string, axis string, v double")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("words"), (F.col("p_type") == "PROMO").alias("sparkling"))
    found = matching.rule_axes(items, cues, priors, {"body": 2.5, "acidity": 3.5})
    half = lambda c: (F.bround(c * 2) / 2).cast("double")
    body, acidity = F.col("body"), F.col("acidity")
    return found.select(F.col("item").alias("p_partkey"), half(F.when(F.col("sparkling"), F.least(body, F.lit(3.0))).otherwise(body)).alias("body"), half(F.when(F.col("sparkling"), F.greatest(acidity, F.lit(4.0))).otherwise(acidity)).alias("acidity"))


@C.query("text_profiles", "H30", r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark),
st AS (SELECT DISTINCT left(x, 5) AS stem FROM (SELECT unnest(ws) AS x FROM w) WHERE length(x) >= 3 UNION SELECT DISTINCT ws[1] || ' ' || ws[2] FROM w WHERE len(ws) > 1),
cues AS (SELECT stem, ['sweetness', 'body', 'acidity', 'oak'][(ascii(stem) + ascii(stem[2:])) % 4 + 1] AS axis, 1 + ascii(stem[3:]) % 9 / 2.0 AS value, CASE WHEN contains(stem, ' ') THEN stem WHEN length(stem) <= 3 THEN ' ' || stem || ' ' ELSE ' ' || stem END AS pattern FROM st),
priors AS (SELECT DISTINCT lang AS kind, axis, 1 + (ascii(lang) + off) % 9 / 2.0 AS value FROM documents, (VALUES ('sweetness', 0), ('body', 3)) v(axis, off) WHERE lang IS NOT NULL),
d AS (SELECT doc_id, lang, n_chars % 5 = 0 AS sparkling, ' ' || trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g')) || ' ' AS s FROM documents),
h AS (SELECT doc_id, axis, avg(value) AS v FROM d JOIN cues ON contains(s, pattern) GROUP BY 1, 2),
a AS (SELECT d.doc_id, any_value(sparkling) AS sparkling, coalesce(any_value(v) FILTER (WHERE h.axis = 'sweetness'), any_value(p.value), 1.5)::DOUBLE AS sweetness, coalesce(any_value(v) FILTER (WHERE h.axis = 'body'), any_value(b.value), 2.5)::DOUBLE AS body,
  coalesce(any_value(v) FILTER (WHERE h.axis = 'acidity'), 3.5)::DOUBLE AS acidity, coalesce(any_value(v) FILTER (WHERE h.axis = 'oak'), 1.5)::DOUBLE AS oak
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN priors p ON p.kind = lang AND p.axis = 'sweetness' LEFT JOIN priors b ON b.kind = lang AND b.axis = 'body' GROUP BY d.doc_id),
l AS (SELECT * REPLACE (CASE WHEN sparkling THEN least(body, 3) ELSE body END AS body, CASE WHEN sparkling THEN greatest(acidity, 4) ELSE acidity END AS acidity) FROM a)
SELECT doc_id, round_even(sweetness * 2, 0) / 2 AS sweetness, round_even(body * 2, 0) / 2 AS body, round_even(acidity * 2, 0) / 2 AS acidity, round_even(oak * 2, 0) / 2 AS oak,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN sparkling THEN 'celebration' END, CASE WHEN sparkling THEN 'aperitif' END, CASE WHEN sweetness >= 3.5 THEN 'dessert' END, CASE WHEN body >= 3.5 THEN 'dinner' END, CASE WHEN body <= 2.5 AND sweetness <= 2 AND NOT sparkling THEN 'picnic' END, CASE WHEN oak >= 3.5 AND body >= 4 THEN 'special' END], lambda o: o IS NOT NULL), ','), ''), 'everyday') AS occasions FROM l""")
def text_profiles(spark, sf_dir):
    """Axes and occasions of every whole text by cues that the benchmark's words and opening phrases give, priors by language."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    single = words.select(F.explode("ws").alias("x")).where(F.length("x") >= 3).select(F.left("x", F.lit(5)).alias("stem"))
    phrase = words.where(F.size("ws") > 1).select(F.concat_ws(" ", F.col("ws")[0], F.col("ws")[1]).alias("stem"))
    letter = lambda k: F.ascii(F.substring("stem", k, 1))
    axis = F.get(F.array(*map(F.lit, ("sweetness", "body", "acidity", "oak"))), (letter(1) + letter(2)) % 4)
    cue = materialize(single.union(phrase).distinct().select("stem", axis.alias("axis"), (1 + letter(3) % 9 / 2).alias("value")), "cues")
    docs = table(spark, sf_dir, "documents")
    prior = lambda a, off: docs.where("lang IS NOT NULL").select(F.col("lang").alias("kind"), F.lit(a).alias("axis"), (1 + (F.ascii("lang") + off) % 9 / 2).alias("value")).distinct()
    items = docs.select(F.col("doc_id").alias("id"), "text", F.array("lang").alias("kinds"), (F.col("n_chars") % 5 == 0).alias("sparkling"))
    found = cues.cue_axes(items, cue, prior("sweetness", 0).union(prior("body", 3)), {"sweetness": 1.5, "body": 2.5, "acidity": 3.5, "oak": 1.5})
    fizz = F.col("sparkling")
    bound = found.withColumns({"body": F.when(fizz, F.least("body", F.lit(3.0))).otherwise(F.col("body")), "acidity": F.when(fizz, F.greatest("acidity", F.lit(4.0))).otherwise(F.col("acidity"))})
    suits = cues.occasions(sweetness=F.col("sweetness"), body=F.col("body"), oak=F.col("oak"), sparkling=fizz)
    return bound.select(F.col("id").alias("doc_id"), *[cues.half_steps(F.col(a)).alias(a) for a in ("sweetness", "body", "acidity", "oak")], F.array_join(suits, ",").alias("occasions"))


@C.query("quiz_profiles", "H31", """
WITH o(question, option, axis, v, aroma, color) AS (VALUES ('drink', 0, 'body', 4.5, 'oak', 'red'), ('drink', 0, 'tannin', 4.0, 'oak', 'red'), ('drink', 1, 'body', 2.0, 'citrus', 'white'), ('dessert', 0, 'sweetness', 4.0, 'honey', NULL), ('dessert', 1, 'sweetness', 1.5, 'apple', NULL), ('coffee', 0, 'tannin', 4.5, NULL, NULL), ('coffee', 1, 'tannin', 2.0, 'vanilla', NULL)),
a AS (SELECT c_custkey, q.question, CASE q.question WHEN 'drink' THEN c_custkey % 2 WHEN 'dessert' THEN c_custkey // 2 % 3 ELSE c_custkey // 3 % 3 END AS option FROM customer, (VALUES ('drink'), ('dessert'), ('coffee')) q(question)),
j AS (SELECT c_custkey, axis, v, aroma, color FROM a JOIN o USING (question, option)),
c AS (SELECT c_custkey, bool_or(color = 'red') AS red, count(color) > 0 AS told, coalesce(string_agg(DISTINCT aroma, '|' ORDER BY aroma), '') AS aromas FROM j GROUP BY c_custkey),
x AS (SELECT c_custkey, axis, round(avg(v), 1) AS v FROM j GROUP BY 1, 2)
SELECT c_custkey, coalesce(string_agg(axis || '=' || v, ',' ORDER BY axis) FILTER (WHERE axis <> 'tannin' OR NOT told OR coalesce(red, false)), '') AS axes, any_value(aromas) AS aromas FROM x JOIN c USING (c_custkey) GROUP BY c_custkey""")
def quiz_profiles(spark, sf_dir):
    """What answers describe: mean axes, aromas; tannin only if no colour or red is among them."""
    options = spark.createDataFrame(
        [("drink", 0, {"body": 4.5, "tannin": 4.0}, "oak", "red"), ("drink", 1, {"body": 2.0}, "citrus", "white"), ("dessert", 0, {"sweetness": 4.0}, "honey", None), ("dessert", 1, {"sweetness": 1.5}, "apple", None), ("coffee", 0, {"tannin": 4.5}, None, None), ("coffee", 1, {"tannin": 2.0}, "vanilla", None)],
        "question string, option long, axes map<string,double>, aroma string, color string",
    )
    n = F.col("c_custkey")
    answers = table(spark, sf_dir, "customer").select(n.alias("profile"), F.explode(F.create_map(F.lit("drink"), n % 2, F.lit("dessert"), F.floor(n / 2) % 3, F.lit("coffee"), F.floor(n / 3) % 3)).alias("question", "option"))
    found = matching.quiz_profiles(answers, options)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("axes"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 1).cast("string")))), ",")
    return found.select(F.col("profile").alias("c_custkey"), text.alias("axes"), F.array_join("aromas", "|").alias("aromas"))


@C.query("soft_buckets", "H22", """
SELECT p_partkey, round(greatest(0, 1 - abs(v - 1.5) / 1.5), 6) AS lo, round(greatest(0, 1 - abs(v - 3) / 1.5), 6) AS mid, round(greatest(0, 1 - abs(v - 4.5) / 1.5), 6) AS hi FROM (SELECT p_partkey, 1 + p_size % 17 / 4.0 AS v FROM part)""")
def soft_buckets(spark, sf_dir):
    """A 1 to 5 axis as low, middle and high."""
    v = 1 + F.col("p_size") % 17 / 4.0
    near = lambda centre: F.round(F.greatest(F.lit(0.0), 1 - F.abs(v - centre) / 1.5), 6)
    return table(spark, sf_dir, "part").select("p_partkey", near(1.5).alias("lo"), near(3.0).alias("mid"), near(4.5).alias("hi"))


@C.query("components", "I1 I2", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM {lineitem} WHERE l_quantity = 50),
edges AS (SELECT DISTINCT a.p AS u, b.p AS v FROM e a JOIN e b ON a.o = b.o),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, x.v FROM reach r JOIN edges x ON x.u = r.v)
SELECT u AS node, min(v) AS component FROM reach GROUP BY u""")
def components(spark, sf_dir, quantity=50):
    """Items bought together in a given quantity, as connected components."""
    sold = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") == quantity).select("l_orderkey", "l_partkey").distinct()
    hub = sold.groupBy("l_orderkey").agg(F.min("l_partkey").alias("u"))
    edges = sold.join(hub, "l_orderkey").select("u", F.col("l_partkey").alias("v"))
    return graph.connected_components(edges, nodes=sold.select(F.col("l_partkey").alias("node")).distinct())


@C.query("duplicate_components", "I1 I2 I3 I4 D9", """
WITH RECURSIVE h AS (SELECT doc_id, source, n_chars, sha256(text) AS a, sha256(regexp_replace(lower(text), '[^a-zà-ÿ0-9]+', ' ', 'g')) AS b FROM documents),
k AS (SELECT doc_id, 'a' || a AS k FROM h UNION ALL SELECT doc_id, 'b' || b FROM h), m AS (SELECT k, min(doc_id) AS u FROM k GROUP BY k HAVING count(*) > 1),
edges AS (SELECT DISTINCT u, doc_id AS v FROM k JOIN m USING (k) UNION SELECT DISTINCT doc_id, u FROM k JOIN m USING (k)),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, x.v FROM reach r JOIN edges x ON x.u = r.v), c AS (SELECT u AS doc_id, min(v) AS component FROM reach GROUP BY u)
SELECT component, count(*) AS n, count(DISTINCT source) AS keys, arg_max(doc_id, struct_pack(a := n_chars, b := -doc_id)) AS representative, sha256('[' || string_agg('{"id":' || doc_id || ',"source":"' || source || '"}', ',' ORDER BY doc_id) || ']') AS version FROM c JOIN h USING (doc_id) GROUP BY component HAVING count(DISTINCT source) > 1""")
def duplicate_components(spark, sf_dir):
    """Documents joined by equal text or equal normal form, groups of more than one source, with representative and version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("a"), F.sha2(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ0-9]+", " "), 256).alias("b"))
    docs = materialize(docs, "hashes")
    keys = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("a"), "a"), F.concat(F.lit("b"), "b"))).alias("k"))
    hub = keys.groupBy("k").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    found = graph.connected_components(keys.join(hub, "k").select("u", F.col("doc_id").alias("v"))).withColumnRenamed("node", "doc_id")
    row = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("id"), "source"))))
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return found.join(docs, "doc_id").groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("source").alias("keys"), best.alias("representative"), F.sha2(row, 256).alias("version")).where("keys > 1")


@C.query("grouped_split", "E13", """
WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(sha256(text), 'null' || doc_id)) AS component FROM documents), c AS (SELECT component, row_number() OVER (ORDER BY sha256('42:' || component)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM h)),
s AS (SELECT component, CASE WHEN n < 3 THEN 'train' WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN rn <= greatest(1, round_even(n * 0.15, 0)) * 2 THEN 'validation' ELSE 'train' END AS split FROM c)
SELECT doc_id AS node, component, split FROM h JOIN s USING (component)""")
def grouped_split(spark, sf_dir):
    """70/15/15 split of documents that keeps equal texts together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    hub = docs.groupBy("h").agg(F.min("doc_id").alias("u"))
    parts = graph.connected_components(docs.join(hub, "h").select("u", F.col("doc_id").alias("v")), nodes=docs.select(F.col("doc_id").alias("node")))
    return graph.grouped_split(parts)


@C.query("char_ngram_neighbours", "H14", """
WITH p AS (SELECT p_partkey AS id, unnest(string_split(lower(p_brand || ' ' || p_name), ' ')) AS w FROM part), b AS (SELECT id, ' ' || w || ' ' AS w FROM p WHERE w <> ''),
s AS (SELECT id, w, n FROM b, (VALUES (3), (4), (5)) g(n) WHERE n <= length(w)), g AS (SELECT id, substring(w, i::BIGINT, n) AS gram FROM (SELECT id, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i FROM s)),
c AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) * 1.0 / (1 + count(*))) + 1 AS idf FROM c GROUP BY gram), r AS (SELECT id, gram, (1 + ln(tf)) * idf AS x FROM c JOIN d USING (gram)),
v AS (SELECT id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM r), t AS (SELECT a.id AS q, b.id, round(sum(a.x * b.x), 6) AS sim FROM v a JOIN v b USING (gram) WHERE a.id % 50 = 0 AND a.id <> b.id GROUP BY 1, 2)
SELECT q, id, sim FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 3""")
def char_ngram_neighbours(spark, sf_dir):
    """The 3 items whose names are nearest in 3- to 5-grams within words; queries are ids divisible by 50."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name").alias("text"))
    return matching.ngram_neighbours(part, k=3, most=5, asked="id % 50 = 0")


@C.query("token_search", "B6 F4", """
SELECT p_partkey AS id, contains(p_name, 'red')::INT + contains(p_name, 'brand#2')::INT AS hits FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#2')""")
def token_search(spark, sf_dir, words=("red", "brand#2")):
    """Items that hold every word the caller gives."""
    items = table(spark, sf_dir, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return entity.token_search(items, list(words), title="p_name", text="text", id_col="p_partkey")


@C.query("indexed_search", "B6 F4", """
WITH d AS (SELECT doc_id AS id, n_chars % 997 AS fit, left(coalesce(text, ''), 40) AS name, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+')) AS words, list_distinct(regexp_extract_all(lower(string_split(coalesce(text, ''), chr(10))[1]), '[a-zà-ÿ]+')) AS title FROM documents),
q AS (SELECT conv_id AS q, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w: length(w) > 3)[1:2]) AS words FROM conversations WHERE turn = 0 AND role = 'user'),
t AS (SELECT q, len(words) AS n, unnest(words) AS term FROM q), p AS (SELECT id, fit, name, unnest(words) AS term, title FROM d),
m AS (SELECT q, id, fit, name, count(*) AS held, max(n) AS n, count(*) FILTER (WHERE list_contains(title, term)) AS hits FROM t JOIN p USING (term) GROUP BY 1, 2, 3, 4)
SELECT q, (row_number() OVER w)::INTEGER AS pos, id, hits FROM m WHERE held = n WINDOW w AS (PARTITION BY q ORDER BY hits DESC, fit DESC, name, id) QUALIFY row_number() OVER w <= 10""")
def indexed_search(spark, sf_dir):
    """The ten documents that hold all words of each opening question, by title hits, fit and name, from an index of blocks."""
    text = F.coalesce("text", F.lit(""))
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-zà-ÿ]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 997).alias("fit"), F.left(text, F.lit(40)).alias("name"), words(text).alias("words"), words(F.split(text, "\n")[0]).alias("title"))
    asked = table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'").select(F.col("conv_id").alias("q"), F.slice(F.filter(words(F.col("text")), lambda w: F.length(w) > 3), 1, 2).alias("words"))
    postings, places = text_index.index(docs)
    return text_index.search(postings, places, asked, k=10).select("q", "pos", "id", "hits")


@C.query("query_constraints", "B7 B14", """
WITH q(q, text) AS (VALUES (1, 'a red ring, not large'), (2, 'cold things without promo'), (3, 'any gear'), (4, 'blue or green plate'), (5, 'nothing special')),
r(field, root, value) AS (VALUES ('color', 'red', 'red'), ('color', 'blue', 'blue'), ('color', 'green', 'green'), ('color', 'cold', 'cold'), ('color', 'large', 'large'), ('noun', 'ring', 'ring'), ('noun', 'gear', 'gear'), ('noun', 'plate', 'plate'), ('type', 'promo', 'PROMO')),
t AS (SELECT q, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM q),
m AS (SELECT q, field, value, contains(s, ' not ' || root) OR contains(s, ' without ' || root) AS no FROM t JOIN r ON contains(s, ' ' || root)),
i AS (SELECT p_partkey AS item, string_split(p_name, ' ')[1] AS color, string_split(p_name, ' ')[2] AS noun, p_type AS type FROM part),
v AS (SELECT item, unnest(['color', 'noun', 'type']) AS field, unnest([color, noun, type]) AS value FROM i),
bad AS (SELECT DISTINCT m.q, v.item FROM v JOIN m USING (field) GROUP BY m.q, v.item, v.field HAVING (count(*) FILTER (WHERE NOT m.no) > 0 AND count(*) FILTER (WHERE NOT m.no AND m.value = v.value) = 0) OR count(*) FILTER (WHERE m.no AND m.value = v.value) > 0)
SELECT q.q, i.item FROM (SELECT DISTINCT q FROM m) q CROSS JOIN i ANTI JOIN bad ON bad.q = q.q AND bad.item = i.item""")
def query_constraints(spark, sf_dir):
    """Constraints read from query texts, asked for or excluded, and the items that meet them."""
    asked = [(1, "a red ring, not large"), (2, "cold things without promo"), (3, "any gear"), (4, "blue or green plate"), (5, "nothing special")]
    rules = [("color", c, c) for c in ("red", "blue", "green", "cold", "large")] + [("noun", n, n) for n in ("ring", "gear", "plate")] + [("type", "promo", "PROMO")]
    queries, held = spark.createDataFrame(asked, "q int, text string"), spark.createDataFrame(rules, "field string, root string, value string")
    word = F.split("p_name", " ")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.array(word[0]).alias("color"), F.array(word[1]).alias("noun"), F.array("p_type").alias("type"))
    return entity.constrained(queries, entity.query_constraints(queries, held), items)
