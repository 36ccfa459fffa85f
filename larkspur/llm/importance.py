"""Importance resampling towards a target distribution by hashed n-grams, DataFrame operations only.

Runs of 1 to 3 words are exploded and hashed into BUCKETS buckets. Bucket counts of the corpus and of
the target give each bucket a gain, the logarithm of how much more often the target uses it; a
document's weight is the sum of the gains of its features. Adding Gumbel noise that is a function of
the id and sorting by the sum draws documents without replacement, in proportion to exp(weight).

No text leaves its task: each of the two passes shuffles at most BUCKETS counts or its own documents' sums
from a task, so a word or a pair that fills a third of the corpus costs what any other does. The gain table has
BUCKETS rows and is broadcast. The draw is a range partition by score with one offset a partition.

Edge cases: a null or wordless text has no features, weight 0 and is never drawn (nor is any text of
fewer than MIN_WORDS words); a null id is hashed as the empty string; repeated rows count and rank each; equal
scores go by id, then by size and text; empty tables give an empty result (an empty target gives every
bucket the gain that smoothing leaves); other columns of the input pass through resampled() whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import field, packed, unpacked
from larkspur.operators.ordering import positions
from larkspur.storage import materialize, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = "42"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def exploded_buckets(rows: DataFrame, text: Column, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keep, n_words and bucket: a row for each run of 1 to 3 words; a text without words has one row of null bucket."""
    worded = rows.select(*keep, words_of(text).alias("_words"))
    size = F.size("_words")
    runs = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), size).alias("b"), F.slice("_words", F.lit(3), size).alias("c"))
    each = worded.select(*keep, size.cast("long").alias("n_words"), F.inline_outer(runs).alias("a", "b", "c"))
    two = F.concat("a", F.lit(" "), "b")  # null where the text ends
    grams = each.select(*keep, "n_words", F.explode(F.array("a", two, F.concat(two, F.lit(" "), "c"))).alias("gram"))
    wanted = grams.where(F.col("gram").isNotNull() | (F.col("n_words") == 0))
    return wanted.select(*keep, "n_words", (F.crc32("gram") % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, text: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    return exploded_buckets(texts, text, [], buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, *, text_col="text", target_text_col="text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), at most `buckets` rows."""
    s = bucket_counts(docs, docs[f"`{text_col}`"], "s", buckets)
    t = bucket_counts(target, target[f"`{target_text_col}`"], "t", buckets)
    both = materialize(s.join(t, "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]), "buckets")
    total = both.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in "st"]).first()  # two numbers
    ratio = ((F.col("t") + 1) * F.lit(total[0] + buckets)) / ((F.col("s") + 1) * F.lit(total[1] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_text: Column, seed: str = SEED) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", buckets: int = BUCKETS, seed: str = SEED, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and tie: one row an input row, written once. keep: further columns, one value a row."""
    table_of_gains = F.broadcast(gains(docs, target, text_col=text_col, buckets=buckets, **options))  # at most `buckets` rows
    named = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), *keep)
    carried = ["_row", "doc_id", "_tie", *keep]
    features = exploded_buckets(named.withColumn("_tie", F.xxhash64("_text")), F.col("_text"), carried, buckets)
    sums = (
        features.join(table_of_gains, "bucket", "left")
        .groupBy("_row")
        .agg(*[F.first(c).alias(c) for c in carried[1:]], F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    )
    score = F.col("weight") + noise(F.col("doc_id").cast("string"), seed)
    return materialize(sums.select("doc_id", "n_features", "n_words", "weight", score.alias("score"), F.col("_tie").alias("tie"), *keep), "scores")


def drawn(scores: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scores with `rank`: 1, 2, 3 ... of the floor(percent / 100) of eligible documents with the highest scores, else null."""
    eligible = F.col("n_words") >= min_words
    n = scores.where(eligible).count() * percent // 100
    placed = positions(scores.withColumn("_out", ~eligible), [F.col("_out"), F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("tie")], "rank")
    return placed.withColumn("rank", F.when(~F.col("_out") & (F.col("rank") <= n), F.col("rank")).cast("long")).drop("_out")


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The drawn documents, all their columns, in order of rank."""
    numbered = materialize(packed(docs).withColumn("n", F.monotonically_increasing_id()), "numbered")
    named = numbered.select("n", field(id_col).alias("doc_id"), field(text_col).alias("text"))
    ranks = drawn(scored(named, target, keep=("n",), **options), percent=percent, min_words=min_words).where("rank IS NOT NULL").select("n", "rank")
    return unpacked(numbered.join(ranks, "n").orderBy("rank"), docs.columns)


def op12_importance_resampling(spark, sf_dir):
    scores = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn(scores).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by bytes: the table of 256 remainders, then one step a byte.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS remainders"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; `remainders` comes from CRC_TABLE."""
    digit = "(instr('0123456789ABCDEF', substring(hex(encode({0})), {1}, 1)) - 1)".format
    byte = f"(16 * {digit(text, '2 * k - 1')} + {digit(text, '2 * k')})"
    bytes_ = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST({byte} AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, remainders[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


ORACLE = rf"""
WITH crc AS ({CRC_TABLE}),
lowered AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), item_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') FROM benchmark),
worded AS (SELECT *, list_filter(regexp_split_to_array(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM lowered),
runs AS (
  SELECT kind, rid, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i : i + n - 1], ' '))) AS gram
  FROM worded, (SELECT unnest([1, 2, 3]) AS n)),
grams AS (SELECT kind, rid, gram, count(*) AS n FROM runs GROUP BY ALL),
buckets AS (SELECT gram, {crc32_sql("gram")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT gram FROM grams), crc),
placed AS (SELECT kind, rid, bucket, sum(n) AS n FROM grams JOIN buckets USING (gram) GROUP BY ALL),
counts AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE kind = 't'), 0) AS DOUBLE) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM counts),
weighed AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY rid),
scored AS (
  SELECT doc_id, len(words) >= {MIN_WORDS} AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (rid) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (WHERE eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
