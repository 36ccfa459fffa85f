"""Quality rules, line first: clean by line, then judge the document by what is left. DataFrame operations only.

Every non-blank line meets three rules. Punctuation: no symbol noise, no shouting, and a line of few
words must end a sentence. Navigation: few separators among its words. Boilerplate: no stock phrase
of licences, cookies or scripts. Failing lines are removed; a document that loses more than
MAX_LOST_PERCENT of its words, or fails the base rules (too few words, too many repeated 8-word
windows), is rejected.

Repetition inside one text stays in its row: 64-bit hashes of all 8-word windows, sorted only for
texts where some hash occurs twice. No shuffle.

Edge cases: a null or blank text has no words and is rejected; lines are compared as they are, a
blank line is neither a duplicate nor removed; repeated rows are judged alike; an empty table gives
an empty result; other columns pass through clean_documents() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import field, packed, unpacked
from larkspur.storage import table

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
SHORT_LINE_WORDS = 4
STOCK_LINE_WORDS = 30  # a longer line only mentions the phrase
SEPARATOR = r"(^| )[|›»•·>/]( |$)"

# Stock phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "skip to content",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "tous droits réservés",
    "todos los derechos reservados",
)
ENDS_SENTENCE = r"""[.!?…。！？:;]["'”’»)\]]*$"""


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, f"{BLANK}+")).otherwise(F.array().cast("array<string>"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_fails(line: Column) -> Column:
    """True for a non-blank line that fails the punctuation, navigation or boilerplate rule."""

    def rules(words: Column) -> Column:
        noise = _count(line, r"[#*$%&|<>{}]") * 10 > words * 3
        shouting = line.contains("!!") & (_count(line, r"!!") * 10 > words * 3)
        fragment = (words < SHORT_LINE_WORDS) & ~F.rtrim(line).rlike(ENDS_SENTENCE)
        navigation = line.rlike(SEPARATOR) & (_count(line, SEPARATOR) * 5 > words)
        stock = (words <= STOCK_LINE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
        return (words > 0) & (fragment | noise | shouting | navigation | stock)

    return _let(_count(line, WORD), rules)


def _window_hashes(words: Column) -> Column:
    """A hash of each 8-word window, from hashes of 1, 2 and 4 words."""

    def joined(hashes: Column, width: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, width + 1, F.greatest(F.size(hashes) - width, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))

    def windows(single: Column) -> Column:
        whole = _let(joined(single, 1), lambda two: _let(joined(two, 2), lambda four: joined(four, 4)))
        return F.slice(whole, F.lit(1), F.greatest(F.size(single) - (WINDOW_WORDS - 1), F.lit(0)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _same_hash(pairs: Column, j: Column, p: Column) -> Column:
    return F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = _let(sorted_pairs, lambda pairs: F.array_sort(F.filter(F.transform(pairs, lambda p, j: F.when(_same_hash(pairs, j - 1, p) | _same_hash(pairs, j + 1, p), p["i"])), lambda i: i.isNotNull())))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW_WORDS).alias("at")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW_WORDS), i - acc["at"])).cast("long").alias("sum"), i.alias("at")),
        lambda acc: acc["sum"],
    )


def _repeated_words(words: Column) -> Column:
    return _let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def _judged(text: Column, max_lost_percent: int) -> Column:
    lines = F.split(text, "\n", -1)
    counts = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))

    def per_line(x: Column) -> Column:
        full = F.filter(x, lambda line: line.rlike(WORD))
        return F.struct(
            _let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("n_dup_lines"),
            _let(F.filter(full, line_fails), lambda f: F.struct(F.size(f).cast("long").alias("n"), _count(F.array_join(f, "\n"), WORD).alias("words"))).alias("failed"),
        )

    def verdict(c: Column, m: Column) -> Column:
        base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"),
            (F.length(text) - _count(text, BLANK)).cast("long").alias("word_chars"),
            _count(text, r"[#*$%&|<>]").alias("n_symbols"),
            m["n_dup_lines"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            base.alias("base_failed"),
            (~base & (100 * m["failed"]["words"] <= max_lost_percent * c["n_words"])).alias("kept"),
            m["failed"]["n"].alias("n_lines_removed"),
            (c["n_words"] - m["failed"]["words"]).alias("n_words_left"),
        )

    return _let(counts, lambda c: _let(_let(lines, per_line), lambda m: verdict(c, m)))


def quality_of(text: Column, *, max_lost_percent=MAX_LOST_PERCENT) -> Column:
    """A struct of counts, base_failed, kept, and what the failing lines hold."""
    return _let(F.coalesce(text, F.lit("")), lambda t: _judged(t, max_lost_percent))


def clean_documents(docs: DataFrame, *, text_col="text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """Kept documents with failing lines removed, columns as in the input."""
    text = field(text_col)
    kept = packed(docs).withColumn("quality", quality_of(text, **options)).where("quality.kept")
    left = F.when(F.col("quality.n_lines_removed") == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line_fails(line)), "\n"))
    new = {text_col: left}
    if length_col in docs.columns:
        new[length_col] = F.length(left).cast(docs.schema[length_col].dataType)
    return unpacked(kept, docs.columns, **new)


def op6_quality_rules(spark, sf_dir):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_left")
    judged = table(spark, sf_dir, "documents").select("doc_id", quality_of(F.col("text")).alias("quality"))
    return judged.select("doc_id", *[f"quality.{n}" for n in names])


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, unnest(regexp_extract_all(text, '{_W}')) AS w, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) AS i FROM d),
windows AS (
  SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS s,
         lead(w, 7) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) > 1 AS twice FROM windows WHERE whole),
covered AS (
  SELECT w.rid, count(*) FILTER (WHERE last_start IS NOT NULL) AS n_repeat_words
  FROM (SELECT w.rid, w.i, max(CASE WHEN c.twice THEN c.i END) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS last_start
        FROM words w LEFT JOIN counted c ON w.rid = c.rid AND w.i = c.i) w
  GROUP BY w.rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d),
judged AS (
  SELECT *, len(regexp_extract_all(line, '{_W}')) AS n,
    row_number() OVER (PARTITION BY rid, line ORDER BY j) > 1 AS again
  FROM lines),
failed AS (
  SELECT *, n > 0 AND (
      len(regexp_extract_all(line, '[#*$%&|<>{{}}]')) * 10 > n * 3
      OR len(regexp_extract_all(line, '!!')) * 10 > n * 3
      OR (n < {SHORT_LINE_WORDS} AND NOT regexp_matches(rtrim(line, ' '), '{ENDS_SENTENCE.replace("'", "''")}'))
      OR len(regexp_extract_all(line, '{SEPARATOR}')) * 5 > n
      OR (n <= {STOCK_LINE_WORDS} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}'))) AS fails
  FROM judged),
per_line AS (
  SELECT rid, count(*) FILTER (WHERE n > 0 AND again) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_removed,
         CAST(coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS BIGINT) AS n_words_left
  FROM failed GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(regexp_extract_all(text, '{_W}')) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_removed, n_words_left
  FROM d JOIN per_line USING (rid) LEFT JOIN covered USING (rid)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * (n_words - n_words_left) <= {MAX_LOST_PERCENT} * n_words AS kept FROM based
"""
