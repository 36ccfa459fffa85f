"""Dense vector search, index building and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import digests
from larkspur.functions import vectors as V
from larkspur.operators.ordering import first_independent
from larkspur.storage import materialize


def _blocks(rows: DataFrame, block: int, name: str) -> tuple[int, DataFrame]:
    """Rows (id, owner, v) dealt into blocks by hash of id: how many, and (b, array of rows). Without owner all have one."""
    if "owner" not in rows.columns:
        rows = rows.withColumn("owner", F.lit(0))
    n = max(1, -(-rows.count() // block))
    return n, rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("id", "owner", "v"))).alias(name))


def _blocked(queries: DataFrame, refs: DataFrame, step, schema: str, block: int) -> DataFrame:
    """step(query ids, query owners, ref ids, ref owners, similarities) for each pair of blocks, one matrix product each.

    Similarities are rounded to six digits; a row is never its own neighbour.
    """
    n, held = _blocks(refs, block, "held")
    _, asked = _blocks(queries, block, "asked")
    pairs = asked.select("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b")).join(held, "b").select("asked", "held")

    def parts(column):
        rows = column.flatten()
        vectors = rows.field(2)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        return rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False), flat.reshape(len(rows), -1)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                (qi, qo, q), (ri, ro, r) = parts(one.column(0)), parts(one.column(1))
                sims = np.round(q @ r.T, 6)
                sims[qi[:, None] == ri[None, :]] = -np.inf
                yield from step(qi, qo, ri, ro, sims)

    return pairs.mapInArrow(run, schema)


def owner_scores(queries: DataFrame, refs: DataFrame, *, block: int = 4096) -> DataFrame:
    """(q, owner, score): highest similarity over an owner's references, from (id, owner, v) on both sides.

    An owner's maximum is taken in each block before it is shuffled.
    """

    def step(qi, qo, ri, ro, sims):
        order = np.argsort(ro, kind="stable")
        owners, first = np.unique(ro[order], return_index=True)
        best = np.maximum.reduceat(sims[:, order], first, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, len(owners))), pa.array(np.tile(owners, len(qi))), pa.array(best.ravel())], ["q", "owner", "score"])

    kinds = [refs.schema[c].dataType.simpleString() for c in ("id", "owner")]
    local = _blocked(queries, refs, step, f"q {kinds[0]}, owner {kinds[1]}, score double", block).where("score > double('-Infinity')")
    return local.groupBy("q", "owner").agg(F.max("score").alias("score"))


def centroids(refs: DataFrame) -> DataFrame:
    """(owner, v): unit vector of the mean of each owner's vectors."""
    means = refs.select("owner", F.posexplode("v").alias("i", "x")).groupBy("owner", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return ordered.select("owner", V.unit("v").alias("v"))


def expand_queries(queries: DataFrame, refs: DataFrame, *, k: int, power: int) -> DataFrame:
    """(q, v): unit sum of each query and its k nearest others weighted by similarity ** power, from (id, owner, v)."""
    near = blocked_topk(queries, refs, k=k).select("q", "id", F.pow(F.greatest("sim", F.lit(0.0)), F.lit(power)).alias("w")).join(refs.select("id", "v"), "id")
    parts = near.select("q", "v", "w").unionByName(queries.select(F.col("id").alias("q"), "v", F.lit(1.0).alias("w")))
    summed = parts.select("q", "w", F.posexplode("v").alias("i", "x")).groupBy("q", "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    ordered = summed.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return ordered.select("q", V.unit("v").alias("v"))


def whitened(rows: DataFrame, *, k: int, id_col: str = "vec_id") -> DataFrame:
    """(id, v): the first k principal components, divided by their standard deviation.

    The covariance is one fixed-size matrix a task, summed by Spark; only its sum reaches the driver.
    """

    def moments(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.v.to_numpy()).astype(float)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    summed = rows.select("v").mapInPandas(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    n = int(summed.i.max()) + 1
    m = np.zeros((n, n))
    m[summed.i, summed.j] = summed.x
    mean = m[0, 1:] / m[0, 0]
    values, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    project = axes[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    project *= np.sign(project[np.abs(project).argmax(axis=0), np.arange(project.shape[1])])

    def apply(batches):
        for pdf in batches:
            x = np.stack(pdf.v.to_numpy()).astype(float) if len(pdf) else np.empty((0, len(mean)))
            yield pd.DataFrame({id_col: pdf[id_col], "v": list((x - mean) @ project)})

    return rows.mapInPandas(apply, f"{id_col} long, v array<double>")


def blocked_topk(queries: DataFrame, refs: DataFrame, *, k: int, foreign: bool = False, block: int = 4096) -> DataFrame:
    """(q, rank, id, sim): exact k most similar others, with `foreign` of other owners only, from (id, owner, v)."""

    def step(qi, qo, ri, ro, sims):
        if foreign:
            sims[qo[:, None] == ro[None, :]] = -np.inf
        at = np.arange(len(ri))[None, :].repeat(len(qi), axis=0)
        if len(ri) > k:  # ties with the k-th stay until ids decide
            floor = np.partition(sims, -k, axis=1)[:, -k]
            rows, cols = np.nonzero(sims >= floor[:, None])
        else:
            rows, cols = np.repeat(np.arange(len(qi)), len(ri)), at.ravel()
        order = np.lexsort((ri[cols], -sims[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        begin = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(qi)))])[rows]
        keep = np.arange(len(rows)) - begin < k
        rows, cols = rows[keep], cols[keep]
        yield pa.RecordBatch.from_arrays([pa.array(qi[rows]), pa.array(ri[cols]), pa.array(sims[rows, cols])], ["q", "id", "sim"])

    kind = refs.schema["id"].dataType.simpleString()
    local = _blocked(queries, refs, step, f"q {kind}, id {kind}, sim double", block).where("sim > double('-Infinity')")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "sim")


def near_in_groups(refs: DataFrame, *, bits: int, rmse: float, block: int = 2048) -> DataFrame:
    """(a, b): pairs a < b of one owner, from (id, owner, v), that differ in at most `bits` signs and whose root mean square difference, to six digits, is under `rmse`.

    Both measures are metrics, so a pair's distances to any one row (the pivot, of least id) differ by no more than
    its own: only blocks of one owner in the same or adjacent bands of both distances are compared. A band of
    any size is cut into blocks by hash of id. Rows without an owner or a vector have no pairs.
    """
    rows = refs.where("owner IS NOT NULL AND v IS NOT NULL")
    pivot = rows.orderBy("id").select("v").first()
    kind = refs.schema["id"].dataType.simpleString()
    if pivot is None:
        return refs.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    p = F.lit(list(pivot.v))
    signs = F.size(F.filter(F.zip_with("v", p, lambda x, y: (x > 0) != (y > 0)), lambda d: d))
    gap = F.sqrt(F.aggregate(F.zip_with("v", p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("v"))
    cell = ["owner", "far", "wide"]
    banded = materialize(rows.select("id", "owner", "v", F.floor(signs / max(bits, 1)).alias("far"), F.floor(gap / (rmse + 1e-6)).alias("wide")), "banded")
    sizes = banded.groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("n"))
    slot = F.pmod(F.xxhash64("id"), F.col("n")).alias("slot")
    dealt = banded.join(sizes, cell).select(*cell, slot, "id", "v")
    blocks = materialize(dealt.groupBy(*cell, "slot").agg(F.collect_list(F.struct("id", "v")).alias("held")), "blocks")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    asked = blocks.select("owner", F.col("slot").alias("own"), F.col("held").alias("asked"), "far", "wide", F.explode(steps).alias("step"))
    moved = asked.select("owner", (F.col("far") + F.col("step.i")).alias("far"), (F.col("wide") + F.col("step.j")).alias("wide"), "asked", F.when((F.col("step.i") == 0) & (F.col("step.j") == 0), F.col("own")).otherwise(0).alias("least"))
    met = moved.join(sizes, cell).withColumn("slot", F.explode(F.sequence("least", F.col("n") - 1))).join(blocks, [*cell, "slot"]).select("asked", "held")

    def parts(column):
        found = column.flatten()
        return found.field(0).to_numpy(zero_copy_only=False), found.field(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(found), -1)

    def compared(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ai, a), (bi, b) = (parts(batch.slice(k, 1).column(c)) for c in range(2))
                differ = (a.shape[1] - np.where(a > 0, 1.0, -1.0) @ np.where(b > 0, 1.0, -1.0).T) / 2
                square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
                apart = np.round(np.sqrt(np.maximum(square, 0) / a.shape[1]), 6)
                i, j = np.nonzero((differ <= bits) & (apart < rmse) & (ai[:, None] != bi[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ai[i], bi[j])), pa.array(np.maximum(ai[i], bi[j]))], ["a", "b"])

    return met.mapInArrow(compared, f"a {kind}, b {kind}")


def kept_apart(refs: DataFrame, *, bits: int, rmse: float, block: int = 2048) -> DataFrame:
    """(id) of the rows that a greedy pass in order of id keeps: no earlier kept row of the owner is near by both measures.

    Copies of a vector share the fate of the first, so only it is compared; the others are near to it and go.
    Rows without an owner or a vector stay.
    """
    loose = refs.where("owner IS NULL OR v IS NULL").select("id")
    first = materialize(refs.where("owner IS NOT NULL AND v IS NOT NULL").groupBy("owner", "v").agg(F.min("id").alias("id")), "first")
    pairs = near_in_groups(first.select("id", "owner", "v"), bits=bits, rmse=rmse, block=block)
    return first_independent(first, pairs).unionByName(loose)


def voted(queries: DataFrame, refs: DataFrame, *, parts: int, k: int, best: int, least: float) -> DataFrame:
    """(q, id, votes, sim): candidates by votes of descriptors, joined by those of the same owner, then verified.

    A vector's equal parts are its descriptors; each votes for its k nearest. The `best` candidates by
    votes and the first `best` rows of the query's owner are compared in full and stay from `least` on.
    """
    width = F.size("v") / parts
    cut = lambda df, i: df.select("id", "owner", V.unit(F.slice("v", (width * i).cast("int") + 1, width.cast("int"))).alias("v"))
    ballots = None
    for i in range(parts):
        near = blocked_topk(cut(queries, i), cut(refs, i), k=k).select("q", "id")
        ballots = near if ballots is None else ballots.unionByName(near)
    votes = ballots.groupBy("q", "id").agg(F.count("*").alias("votes"))
    ranked = votes.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("votes"), "id"))).where(F.col("rn") <= best).select("q", "id")
    known = refs.withColumn("rn", F.row_number().over(Window.partitionBy("owner").orderBy("id"))).where(F.col("rn") <= best).select("id", "owner")
    same = queries.select(F.col("id").alias("q"), "owner").join(known, "owner").where("q <> id").select("q", "id")
    pairs = ranked.union(same).distinct().join(votes, ["q", "id"], "left").fillna({"votes": 0})
    full = pairs.join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").join(refs.select("id", "v"), "id")
    return full.select("q", "id", "votes", F.round(V.dot("qv", "v"), 6).alias("sim")).where(F.col("sim") >= least)


# P(n <= 0), P(n <= 1), ... of a Poisson number of mean 1, up to what a 32-bit draw can tell apart.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)), 9) for n in range(12))


def _together(rounds: int, most: int) -> list[list[int]]:
    """Rounds in groups of at most `most` whose numbers have as many digits."""
    groups: list[list[int]] = []
    for r in range(rounds):
        if not groups or len(groups[-1]) == most or len(str(groups[-1][0] + 1)) != len(str(r + 1)):
            groups.append([])
        groups[-1].append(r)
    return groups


def bootstrap_mean(rows: DataFrame, *, rounds: int) -> DataFrame:
    """(mean, low, high) of x over Poisson resamples of rows (h, x): one pass with two sums a round and task, no sample is built.

    A row draws anew in each round, from the first 32 bits of the md5 of its name h and the round: a draw
    u = (bits + 0.5) / 2^32 exceeds a limit from a fixed number of bits on. Names of one length are hashed together.
    """
    dealt = rows.where("h IS NOT NULL AND x IS NOT NULL").select(F.col("h").cast("string").alias("h"), F.col("x").cast("double").alias("x")).repartition("h")  # a file's few tasks would do all draws
    starts = np.array([math.floor(limit * 2**32 - 0.5) + 1 for limit in POISSON if limit * 2**32 - 0.5 < 2**32 - 1], np.uint32)
    # a draw's upper half tells its number, unless a start lies in that half's range
    halves = np.searchsorted(starts, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16), side="right").astype(np.uint8)
    halves[starts >> np.uint32(16)] = 255

    def summed(batches):
        total, count = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            names = batch.column(0).cast(pa.binary())
            sizes, x = pc.binary_length(names).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                flat = np.frombuffer(b"".join(names.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), size)
                for some in _together(rounds, max(1, 16384 // len(at))):
                    suffix = np.frombuffer(b"".join(b":%d" % (r + 1) for r in some), np.uint8).reshape(len(some), -1)
                    asked = np.concatenate([np.tile(flat, (len(some), 1)), np.repeat(suffix, len(at), axis=0)], axis=1)
                    bits = digests.first_bits(asked, asked.shape[1], b"")
                    n = halves[bits >> np.uint32(16)]
                    edge = np.flatnonzero(n == 255)
                    n[edge] = np.searchsorted(starts, bits[edge], side="right")
                    n = n.reshape(len(some), len(at)).astype(float)
                    total[some] += n @ x[at]
                    count[some] += n.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(total), pa.array(count)], ["round", "total", "n"])

    sums = dealt.mapInArrow(summed, "round long, total double, n double")
    means = sums.groupBy("round").agg((F.sum("total") / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
