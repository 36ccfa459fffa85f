"""Mixing sources to target weights by weighted fair queueing, DataFrame operations only.

Each source is a queue of its documents in shuffled order, served in passes. A copy's virtual
finish time is the cumulative words of its source up to its end, divided by the source's weight.
Served in ascending finish time, all sources progress at one virtual clock; the words served by
clock c are sum(min(max_repeats * source_words, weight * c)). The mix is cut at the clock
where that reaches the budget, so a source that runs out passes its share to the others by weight.

Cumulative words use two levels: each source is cut into `buckets` ranges of the shuffle key, whose
totals are summed first, so no source has to fit one task.

Edge cases: a null or blank text has size 0 and takes nothing; a null source is a source of its own,
last in order; a null id shuffles first; repeated rows count each; an empty table gives an empty
plan; other columns of the input pass through mixed_documents() whatever their names and are not
read by mixing_plan().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.rows import field, packed, unpacked
from larkspur.storage import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]*"
WEIGHT_CYCLE = (3, 1, 2)
BUDGET_RATIO = 1.5
MAX_REPEATS = 2
BUCKET_DIGITS = 3  # 16 ** 3 ranges of the shuffle key per source


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHT_CYCLE, budget_ratio=BUDGET_RATIO, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target, clock): one row a source.

    The clock solves sum(least(cap, weight * clock)) = budget: with sources by the clock at which
    they run out, it is the first (budget - caps before) / (weights left) not beyond its row's own.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = per_source.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"),
    ).withColumns({"cap": F.col("source_size") * F.lit(float(max_repeats)), "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget_ratio))})
    by_end = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_end.rowsBetween(Window.unboundedPreceding, -1), by_end.rowsBetween(0, Window.unboundedFollowing)
    clocks = weighed.select("*", F.row_number().over(by_end).alias("rank"), ((F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("candidate"))
    clock = F.min_by(F.when(F.col("candidate") <= F.col("cap") / F.col("weight"), F.col("candidate")), F.when(F.col("candidate") <= F.col("cap") / F.col("weight"), F.col("rank"))).over(Window.partitionBy())
    return clocks.withColumn("clock", clock).select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("clock")).alias("target"), "clock")


def mixing_plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHT_CYCLE, budget_ratio=BUDGET_RATIO, max_repeats=MAX_REPEATS, carry=False) -> DataFrame:
    """One row a document: doc_id, source, shuffle_key, size, source_size, weight, target, clock, begin, taken; with carry also the input row.

    begin: the source's words before it in a pass. taken: words of all its copies that the mix serves.
    """
    keyed = packed(docs).select(
        field(id_col).alias("doc_id"),
        field(source_col).alias("source"),
        F.md5(F.coalesce(field(id_col).cast("string"), F.lit(""))).alias("shuffle_key"),
        word_count(field(text_col)).alias("size"),
        F.xxhash64(field(text_col)).alias("tie"),
        *["row"] * carry,
    ).withColumn("bucket", F.substring("shuffle_key", 1, BUCKET_DIGITS))
    sizes = materialize(keyed.drop("row"), "sizes")
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("offset"))
    sources = source_targets(sizes, weights, budget_ratio, max_repeats)
    ranges = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "bucket", "offset", "source_size", "weight", "target", "clock")
    within = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    local = (keyed if carry else sizes).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = (
        local.alias("d")
        .join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.bucket") == F.col("r.bucket")))
        .select("d.doc_id", "d.source", "d.shuffle_key", "d.size", "source_size", "weight", "target", "clock", (F.col("inner") + F.col("offset")).alias("begin"), *["row"] * carry)
    )
    return placed.withColumn("taken", _served(placed, max_repeats))


def _served(plan: DataFrame, passes: int):
    """Words served over all passes; the copy in service when the clock stops is cut."""
    quota = F.floor(plan["target"]).cast("long")
    served = [F.greatest(F.lit(0).cast("long"), F.least(plan["size"], quota - plan["begin"] - k * plan["source_size"])) for k in range(passes)]
    total = served[0]
    for s in served[1:]:
        total = total + s
    return total.cast("long")


def mixed_documents(docs: DataFrame, *, text_col="text", length_col="n_chars", max_repeats=MAX_REPEATS, **options) -> DataFrame:
    """The mix itself: the documents' columns, a row for each copy served, globally range-sorted by virtual finish time.

    The copy that the budget cuts keeps its text up to the end of its last word served.
    """
    plan = mixing_plan(docs, text_col=text_col, max_repeats=max_repeats, carry=True, **options)
    copies = plan.where("taken > 0").select("*", F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])).alias("copy"))
    ahead = F.col("begin") + F.col("copy") * F.col("source_size")
    served = copies.select("row", "doc_id", "size", "copy", F.least(F.col("size"), F.floor("target").cast("long") - ahead).alias("words"), ((ahead + F.col("size")) / F.col("weight")).alias("finish")).where("words > 0")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, _first_words(field(text_col), F.col("words"))).otherwise(field(text_col))
    new = {text_col: text}
    if length_col in docs.columns:
        new[length_col] = F.when(cut, F.length(text).cast(docs.schema[length_col].dataType)).otherwise(field(length_col))
    return unpacked(served.orderBy("finish", "doc_id", "copy"), docs.columns, **new)


def _first_words(text, n):
    """The text up to the end of its n-th word, as it stands: each match starts where the last one ended."""
    words = F.regexp_extract_all(text, F.lit(BLANKS + WORD), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def op3_source_mixing(spark, sf_dir):
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    finish = (F.col("begin") + F.col("size")) / F.col("weight")
    return plan.orderBy(finish, "source", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM per_source),
clocks AS (
  SELECT *, row_number() OVER w AS rank,
         (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST)),
clock AS (SELECT candidate AS clock FROM clocks WHERE candidate <= cap / weight ORDER BY rank LIMIT 1),
targets AS (SELECT source, source_size, weight, least(cap, weight * clock) AS target FROM clocks, clock),
placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - begin_at)) + greatest(0, least(size, floor(target) - begin_at - source_size)) AS BIGINT) AS taken
FROM placed
"""
