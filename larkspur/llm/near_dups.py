"""MinHash near-duplicates with tensored banding, links confirmed on full shingle sets.

A document's minhashes form COLLECTIONS small collections of ROWS values on either side. Every table
key combines one collection of the left side with one of the right, so COLLECTIONS ** 2 tables need
only 2 * COLLECTIONS * ROWS minhashes. A pair of similarity s meets in some table with probability
(1 - (1 - s ** ROWS) ** COLLECTIONS) ** 2: 0.9999 at s = 0.8, 0.9995 at 0.75.

Equal shingle sets collapse to their smallest id first. A side's collection that no other set shares
can't take part in a meeting key, so keys are formed from shared ones alone. Each table group sends
its members to its smallest one only; links are confirmed on whole sets. Groups that this leaves in
several components are finished exactly: their members are joined by prefix filter (rarest shingles
first), across components, so that no link inside such a group is lost.

Edge cases: a text without words (null, empty, blank) has an empty set, no links and keeps itself;
under five words the whole sequence is the one shingle; rows that repeat an id are one node, judged
alike; a null id takes no part, gets a null component and is kept; an empty table gives an empty
result; other columns of the input are ignored by near_duplicates() and kept by deduplicate().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected_components
from larkspur.llm.rows import field, packed, unpacked
from larkspur.storage import materialize, table

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
COLLECTIONS = 10
HOT = 1000
ROWS = 2
WORD_MEMO = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hash of each word seen; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, memo: dict, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    acc = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * _MIX + codes[k : len(words) - width + 1 + k]
    return np.unique(_scramble(acc))


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    best = np.full(len(multipliers), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
        part = shingles[at : at + 4096]
        best = np.minimum(best, (part[None, :] * multipliers[:, None] ^ (part >> np.uint64(17))[None, :]).min(axis=1))
    return best


def _signatures(batches):
    memo, multipliers = _WordHashes(), _multipliers(2 * COLLECTIONS * ROWS)
    for batch in batches:
        ids, sizes, prints, sides = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shingles = shingle_set(text, memo)
            ids.append(doc_id)
            sizes.append(len(shingles))
            prints.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            values = _scramble(minhashes(shingles, multipliers)).reshape(2 * COLLECTIONS, ROWS)
            folded = values[:, 0].copy()
            for r in range(1, ROWS):
                folded = folded * _MIX + values[:, r]
            sides.append(_scramble(folded).view(np.int64))
        flat = pa.array(np.concatenate(sides) if sides else np.empty(0, np.int64))
        offsets = pa.array(np.arange(0, len(flat) + 1, 2 * COLLECTIONS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n", "print", "sides"])


def _sets(batches):
    memo = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t, memo).view(np.int64) for t in part.column(1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["doc_id", "shingles"])


def _table_keys(nodes: DataFrame) -> DataFrame:
    """(key, doc_id, n) of keys formed from collections that at least two nodes share."""
    halves = nodes.select("doc_id", "n", F.posexplode("sides").alias("slot", "value"))
    shared = halves.groupBy("slot", "value").agg(F.count("*").alias("c")).where("c > 1").select("slot", "value")
    found = halves.join(shared, ["slot", "value"]).groupBy("doc_id", "n").agg(F.collect_list(F.struct("slot", "value")).alias("halves"))
    left = found.select("doc_id", "n", F.explode(F.filter("halves", lambda h: h["slot"] < COLLECTIONS)).alias("a"), F.filter("halves", lambda h: h["slot"] >= COLLECTIONS).alias("right"))
    return left.select("doc_id", "n", "a", F.explode("right").alias("b")).select(F.xxhash64("a.slot", "a.value", "b.slot", "b.value").alias("key"), "doc_id", "n")


def _similar_sizes(a: str, b: str):
    return 100 * F.least(a, b) >= SIMILARITY_PERCENT * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    left, right = sets.toDF("u", "su"), sets.toDF("v", "sv")
    both = pairs.join(right, "v").join(left, "u")
    common = F.size(F.array_intersect("su", "sv")).cast("long")
    return both.where(100 * common >= SIMILARITY_PERCENT * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _finish(keys: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links between components within table groups of three or more that the first round left apart."""
    part = connected_components(links)
    placed = keys.join(part, keys["doc_id"] == part["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    apart = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("c > 2 and lo < hi").select("key")
    open_docs = placed.join(apart, "key").select("doc_id", "part").distinct()
    tokens = sets.join(open_docs, "doc_id").select("doc_id", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(rarity, "token").groupBy("doc_id", "part", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_rarity"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY_PERCENT / 100)).cast("int") + 1
    prefix = materialize(ordered.select("doc_id", "part", "n", F.posexplode(F.slice("by_rarity", F.lit(1), length)).alias("at", "t")).where("t.df > 1").select("doc_id", "part", "n", "at", F.col("t.token").alias("token")), "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(SIMILARITY_PERCENT / (100 + SIMILARITY_PERCENT)) - 1e-9)
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    across = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")) & _similar_sizes("x.n", "y.n") & (reach >= needed)
    return _confirmed(x.join(y, across).select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v")).distinct(), sets)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signs = materialize(source.mapInArrow(_signatures, "doc_id long, n long, print binary, sides array<long>"), "signatures")
    nodes = signs.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sides").alias("sides"))
    keys = materialize(_table_keys(nodes), "keys")
    heads = keys.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("c")).where("c > 1").select("key", "head")
    pairs = keys.join(heads, "key").select(F.col("head.doc_id").alias("u"), F.col("head.n").alias("nu"), F.col("doc_id").alias("v"), F.col("n").alias("nv"))
    pairs = materialize(pairs.where((F.col("u") < F.col("v")) & _similar_sizes("nu", "nv")).select("u", "v").distinct(), "pairs")
    shared = keys.join(heads, "key", "left_semi").select("doc_id").distinct()
    sets = materialize(source.join(shared, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    links = materialize(_confirmed(pairs, sets), "links")
    links = links.union(_finish(keys, sets, links))
    parts = connected_components(links)
    heads_of = signs.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    named = materialize(heads_of.join(parts, heads_of["head"] == parts["node"], "left").select("print", "head", "component", "copies"), "named")
    # Copies of one set meet by its print; sets with more than 1 / HOT of all rows are fewer than HOT and are broadcast.
    total = named.agg(F.sum("copies").alias("total"))
    hot = materialize(named.crossJoin(F.broadcast(total)).where(F.col("copies") * HOT > F.col("total")).select("print", "head", "component"), "hot")
    rows = signs.select("doc_id", "n", "print")
    placed = rows.join(F.broadcast(hot), "print").unionByName(rows.join(F.broadcast(hot.select("print")), "print", "left_anti").join(named.drop("copies"), "print", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that stay: one of each group of near-duplicates, columns as in the input."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return unpacked(packed(docs).join(gone, field(id_col).cast("long") == F.col("gone"), "left_anti"), docs.columns)


def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
