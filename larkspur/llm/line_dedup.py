"""Line dedup by site-relative frequency.

Within each host, a line's frequency is the pages that hold it divided by the host's pages. Lines on
more than RATIO_PERCENT of the pages, and on MIN_PAGES at least, are boilerplate and dropped from
every page of the host.

Each page gives a line once, as a 96-bit hash, and counts are partial before they are shuffled. A host
has at most (lines per page) * 100 / RATIO_PERCENT boilerplate lines, whatever its size: its list is
bounded. Pages meet their host's list by host and slice: a host with more than 1 / SLICES of all pages
is cut into slices of about that size by a hash of the row, and its list goes to each. There are fewer
than SLICES such hosts, so their table is broadcast.

Edge cases: a null text has no lines and stays null; lines are compared without blanks at their ends;
blank lines are never dropped; rows without a host form one host of their own; repeated rows are
pages of their own in op7, and one text in clean_documents(); an empty table gives an empty result; other columns pass through whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import field, packed, unpacked
from larkspur.storage import materialize, table

RATIO_PERCENT = 10
MIN_PAGES = 3
SLICES = 1000
BLANKS = " \t\x0b\x0c\r"

# What is invisible in a page, and the tags that end a line.
INVISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
LINE_ENDS = r"(?i)</?(?:p|div|li|ul|ol|nav|article|header|footer|section|h[1-6]|tr|table|br|body|html)\b[^>]*>"
TAG = r"<[^>]*>"


def visible_text(html: Column) -> Column:
    """Lines of a page: block tags end lines, other tags and invisible parts go."""
    shown = F.regexp_replace(html, INVISIBLE, "\n")
    broken = F.regexp_replace(shown, LINE_ENDS, "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(broken, TAG, ""), r"[ \t\r]*\n[ \t\r\n]*", "\n"), F.lit(" \t\r\n"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.hash(_bare(line)).alias("b"))


def boilerplate(pages: DataFrame, *, ratio_percent=RATIO_PERCENT, min_pages=MIN_PAGES, copies_once=False) -> DataFrame:
    """(host, keys): hashes of each host's boilerplate lines, from columns host and text.

    copies_once: pages of one host whose texts are equal but for blanks count as one text; the ratio is
    one of texts, and a line that a single text holds, however often, is no boilerplate.
    """
    full = F.filter(F.split("text", "\n", -1), lambda x: _bare(x) != "")
    held = pages.select("host", F.transform(full, _key).alias("lines"), F.lit(1).cast("long").alias("copies"))
    if copies_once:
        held = held.groupBy("host", F.xxhash64("lines").alias("a"), F.hash("lines").alias("b")).agg(F.first("lines").alias("lines"), F.sum("copies").alias("copies"))
    lines = held.select("host", "copies", F.explode(F.array_distinct("lines")).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("copies").alias("held_by")).where(F.col("held_by") >= min_pages)
    if copies_once:
        counts = counts.where("n > 1")
    totals = held.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.join(totals, "host").where(100 * F.col("n") > ratio_percent * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("keys"))


def _sliced(held: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of held with their host's list, or null; hot hosts slice by slice."""
    sizes = held.groupBy("host").agg(F.count("*").alias("pages"))
    total = sizes.agg(F.sum("pages").alias("total"))
    hot = sizes.crossJoin(F.broadcast(total)).where(F.col("pages") * SLICES > F.col("total"))  # fewer than SLICES rows
    hot = materialize(hot.select("host", F.ceil(F.col("pages") * SLICES / F.col("total")).cast("long").alias("slices")), "hosts")
    count = F.coalesce("slices", F.lit(1).cast("long"))
    dealt = held.join(F.broadcast(hot), "host", "left").withColumn("slice", F.pmod("salt", count)).drop("slices")
    spread = lists.join(F.broadcast(hot), "host", "left").select("host", "keys", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("slice"))
    return dealt.join(spread, ["host", "slice"], "left")


def drop_boilerplate(docs: DataFrame, *, text, host, **options) -> DataFrame:
    """(row, text, n_lines, n_dropped): input rows, packed, with the text that is left; text and host map the packed row to columns."""
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    salt = F.xxhash64(*[field(c) for c in plain]) if plain else F.lit(0).cast("long")
    held = packed(docs).select("row", text(field).alias("text"), F.coalesce(F.concat(F.lit("."), host(field)), F.lit("")).alias("host"), salt.alias("salt"))
    lists = boilerplate(held.select("host", "text"), **options)
    joined = _sliced(held, lists)
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains("keys", _key(x))))
    counted = joined.select("row", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), left.alias("left"))
    dropped = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size("left"))
    return counted.select("row", F.array_join("left", "\n").alias("text"), "n_lines", dropped.alias("n_dropped"))


def site_texts(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, host, text): visible text of pages, written once since counts and cleaning both read it."""
    return materialize(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), visible_text(F.col(html_col)).alias("text")), "texts")


def clean_documents(docs: DataFrame, *, text_col="text", host_col="source", length_col="n_chars", **options) -> DataFrame:
    """Documents without their sites' boilerplate, columns as in the input; a text that loses all its words goes.

    Copies of a text count once in its host, so that they don't make its own lines boilerplate and near-dedup finds them.
    """
    left = drop_boilerplate(docs, text=lambda f: f(text_col), host=lambda f: f(host_col).cast("string"), copies_once=True, **options)
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[length_col].dataType)).otherwise(field(length_col))
    return unpacked(left, docs.columns, **new)


def op7_line_dedup(spark, sf_dir):
    pages = site_texts(table(spark, sf_dir, "pages"))
    done = drop_boilerplate(pages, text=lambda f: f("text"), host=lambda f: f("host"))
    return done.select(field("page_id").alias("page_id"), field("host").alias("host"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH shown AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_replace(html, '{INVISIBLE}', chr(10), 'g') AS t
  FROM pages),
broken AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '{LINE_ENDS}', chr(10), 'g'), '{TAG}', '', 'g') AS t FROM shown),
texts AS (SELECT row_number() OVER () AS rid, page_id, host, trim(regexp_replace(t, '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM broken),
lines AS (
  SELECT rid, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM texts),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM lines),
counts AS (SELECT host, b, count(DISTINCT rid) AS n FROM bare WHERE b <> '' GROUP BY host, b),
totals AS (SELECT host, count(*) AS pages FROM texts GROUP BY host),
often AS (SELECT c.host, b FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= {MIN_PAGES} AND 100 * n > {RATIO_PERCENT} * pages),
marked AS (SELECT l.rid, j, line, o.b IS NOT NULL AS gone FROM bare l LEFT JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.b = o.b)
SELECT t.page_id, t.host, count(m.j) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       CASE WHEN t.t IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT gone), '')) END AS kept_sha256
FROM texts t LEFT JOIN marked m USING (rid) GROUP BY t.rid, t.page_id, t.host, t.t
"""
