"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

Codes are cut into m segments of about log2(codes in a shard) bits, one table a segment. A query
probes the tables at growing segment radius: once radius r is done for the first a segments and r - 1
for the others, every code within Hamming distance m * r + a - 1 has been met. Search ends when k
verified rows lie within that distance, so the result is exact.

Equal codes collapse to one entry with its k + 1 smallest ids, limited before the shuffle, so a code
that a third of the rows share is one entry. Entries are dealt to shards of about SHARD_CODES by hash
of the code, queries to blocks of QUERY_BLOCK. A shard goes to LANES tasks at most, which build its
index once and stream the blocks of queries past it, and the k best of each shard are merged by query.

Edge cases: rows without a vector (null or empty) have no code and take no part; a null element counts
as not positive; a query row is not its own neighbour; equal distances are ordered by id; fewer than
k other rows give fewer results; repeated ids count once a code; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.storage import materialize, table

BITS = 64
SHARD_CODES = 1 << 16
QUERY_BLOCK = 1 << 10
LANES = 8
K = 10


def sign_code(vector: str):
    """64-bit code: bit i is set where element i is positive."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


class MultiIndex:
    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.m = max(1, min(BITS, round(BITS / max(1.0, math.log2(max(2, len(codes)))))))
        cuts = [BITS * s // self.m for s in range(self.m + 1)]
        self.segments = [(np.uint64(a), b - a) for a, b in itertools.pairwise(cuts)]
        self.tables = []
        for shift, width in self.segments:
            values = (codes >> shift) & np.uint64((1 << width) - 1)
            order = np.argsort(values, kind="stable")
            distinct, starts = np.unique(values[order], return_index=True)
            self.tables.append((order, distinct, np.append(starts, len(codes))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        self.met = np.full(len(codes), -1, np.int64)
        self.searches = 0

    def _buckets(self, segment: int, value: np.uint64, radius: int) -> np.ndarray:
        """Buckets of the segment's table whose value differs from the given one in radius bits."""
        _, width = self.segments[segment]
        _, distinct, _ = self.tables[segment]
        if radius > width:
            return np.empty(0, np.int64)
        if math.comb(width, radius) >= len(distinct):
            return np.flatnonzero(np.bitwise_count(distinct ^ value) == radius)
        key = (width, radius)
        if key not in self.masks:
            self.masks[key] = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.uint64)
        probes = self.masks[key] ^ value
        at = np.searchsorted(distinct, probes)
        at[at == len(distinct)] = 0
        return at[distinct[at] == probes]

    def search(self, code: int, k: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) that hold every entry as near as the k-th row; weights: rows an entry."""
        self.searches += 1
        code = np.uint64(code)
        found, distances = [], []
        within = np.zeros(BITS + 2, np.int64)
        for radius in range(BITS + 1):
            for s, (shift, width) in enumerate(self.segments):
                order, _, starts = self.tables[s]
                buckets = self._buckets(s, (code >> shift) & np.uint64((1 << width) - 1), radius)
                if len(buckets):
                    sizes = starts[buckets + 1] - starts[buckets]
                    ends = np.cumsum(sizes)
                    entries = order[np.arange(ends[-1]) + np.repeat(starts[buckets] - (ends - sizes), sizes)]
                    entries = entries[self.met[entries] != self.searches]
                    self.met[entries] = self.searches
                    d = np.bitwise_count(self.codes[entries] ^ code).astype(np.int64)
                    found.append(entries)
                    distances.append(d)
                    np.add.at(within, d, weights[entries])
                covered = self.m * radius + s
                if covered >= BITS or within[: covered + 1].sum() >= k:
                    entries, d = np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(distances or [np.empty(0, np.int64)])
                    return entries[d <= covered], d[d <= covered]
        raise AssertionError("radius beyond the code length")


def _searched(k: int):
    """Results of query blocks; input sorted by shard and lane, a shard's entries before the queries that are streamed past them."""

    def found(index, ids, weights, queries):
        out = []
        for q in queries:
            near, distances = index.search(q["code"] & (1 << BITS) - 1, k + 1, weights)
            order = np.argsort(distances, kind="stable")
            best, last = [], None
            for e, d in zip(near[order].tolist(), distances[order].tolist(), strict=True):
                if len(best) > k and d != last:
                    break
                best += [(d, i) for i in ids[e]]
                last = d
            out += [(q["id"], i, d) for d, i in sorted(x for x in best if x[1] != q["id"])[:k]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["query_id", "vec_id", "distance"])

    def run(batches):
        index = ids = weights = None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                if row["seq"] == 0:
                    entries = row["entries"]
                    index = MultiIndex(np.array([e["code"] for e in entries], np.int64).view(np.uint64))
                    ids = [e["ids"] for e in entries]
                    weights = np.array([len(x) for x in ids], np.int64)
                else:
                    yield found(index, ids, weights, row["queries"])

    return run


def hamming_topk(rows: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query, from tables (id, code)."""
    smallest = Window.partitionBy("code").orderBy("id")
    held = rows.where("code is not null and id is not null").select("id", "code").distinct()
    entries = held.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "codes")
    n_shards = max(1, -(-entries.count() // SHARD_CODES))
    asked = queries.where("code is not null and id is not null").select("id", "code").distinct()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = entries.groupBy(F.pmod(F.xxhash64("code"), F.lit(n_shards)).alias("shard")).agg(F.collect_list(F.struct("code", "ids")).alias("entries"))
    blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", "code")).alias("queries"))
    lanes = min(n_blocks, LANES)
    held = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), F.lit(0).cast("long").alias("seq"), "entries")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard")
    spread = blocks.select("block", "queries", every).join(shards.select("shard"), "shard", "left_semi")
    spread = spread.select("shard", F.pmod("block", F.lit(lanes)).alias("lane"), (F.col("block") + 1).alias("seq"), "queries")
    rows = held.unionByName(spread, allowMissingColumns=True).repartition(min(n_shards * lanes, 4096), "shard", "lane").sortWithinPartitions("shard", "lane", "seq")
    local = rows.select("seq", "entries", "queries").mapInArrow(_searched(k), "query_id long, vec_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op2_hamming_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return hamming_topk(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH coded AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(hamming(q.code, r.code) AS INTEGER) AS distance
  FROM coded q JOIN coded r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs) WHERE rank <= 10
"""
