"""Exact nearest neighbours of all rows through a coarse index of balls, and the augmentation of a database by them.

A cell of the index is a ball: a centre and the widest angle of its rows from it. The triangle inequality of angles
bounds a row's similarity to everything in a ball, so a row goes only to the balls that can still hold one of its
k nearest. Bounds depend on the data, results don't: vectors without clusters are only compared more often.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.storage import discard, materialize

SLACK = 1e-5  # more than what rounding of similarities and single-precision vectors can hide


@dataclass
class Balls:
    """rows (cell, slot, id, v) of every indexed vector; centres and radii (angles), a row a cell."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    slots: np.ndarray

    def delete(self) -> None:
        discard(self.rows)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _centres(rows: DataFrame, cells: int, per_cell: int, rounds: int) -> np.ndarray:
    """Centres from at most cells * per_cell rows of least hash: spherical k-means of a few rounds."""
    held = rows.orderBy(F.xxhash64("id"), "id").limit(cells * per_cell).select("v").toPandas().v
    x = np.stack(held.to_numpy()).astype(float)
    centres = x[:cells].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1)
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


def ball_index(rows: DataFrame, *, cells: int = 4096, per_cell: int = 16, rounds: int = 3, block: int = 2048) -> Balls:
    """Index of (id, v), v unit vectors of one length: the root of their number of cells, at most `cells`.

    Centres are fitted on a sample of at most cells * per_cell rows (the bound of what the driver holds); every row is
    indexed. A cell of any size is cut into slots of about `block` rows by hash of id. Rows without id or vector are left out.
    """
    known = rows.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    n = known.count()
    if n == 0:
        empty = known.select(F.lit(0).alias("cell"), F.lit(0).alias("slot"), "id", "v")
        return Balls(materialize(empty, "balls"), np.empty((0, 0)), np.empty(0), np.empty(0, int))
    centres = _centres(known, max(1, min(cells, math.isqrt(n))), per_cell, rounds)
    kind, vector = known.schema["id"].dataType.simpleString(), known.schema["v"].dataType.simpleString()

    def assigned(batches):
        for batch in batches:
            if batch.num_rows:
                sims = _matrix(batch.column(1)) @ centres.T
                cell = sims.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(sims[np.arange(len(cell)), cell])], ["id", "v", "cell", "near"])

    placed = materialize(known.mapInArrow(assigned, f"id {kind}, v {vector}, cell int, near double"), "placed")
    radii, slots = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in placed.groupBy("cell").agg(F.min("near").alias("far"), F.count("*").alias("n")).collect():  # a row a cell
        radii[r.cell], slots[r.cell] = math.acos(max(-1.0, min(1.0, r.far))), -(-r.n // block)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    dealt = placed.join(sizes, "cell")
    indexed = materialize(dealt.select("cell", F.pmod(F.xxhash64("id"), F.col("many")).cast("int").alias("slot"), "id", "v"), "balls")
    discard(placed)
    return Balls(indexed, centres, radii, slots)


def _compared(asked: DataFrame, index: Balls, *, k: int, block: int) -> DataFrame:
    """(q, id, sim): of each asked row (cell, q, v, floor) the k best in each slot of that cell, none below its floor."""
    kind, vector = (index.rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    held = index.rows.groupBy("cell", "slot").agg(F.collect_list(F.struct("id", "v")).alias("held"))
    load = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    part = F.pmod(F.xxhash64("q", F.lit(1)), F.col("many"))
    asking = asked.join(load, "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("q", "v", "floor")).alias("asking"))
    met = asking.join(held, "cell").select("asking", "held")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                a, h = (batch.slice(at, 1).column(c).flatten() for c in range(2))
                q, floor = (a.field(f).to_numpy(zero_copy_only=False) for f in (0, 2))
                ids = h.field(0).to_numpy(zero_copy_only=False)
                sims = np.round(_matrix(a.field(1)) @ _matrix(h.field(1)).T, 6)
                sims[q[:, None] == ids[None, :]] = -np.inf
                least = floor
                if len(ids) > k:  # ties with the k-th stay until ids decide
                    least = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
                i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                order = np.lexsort((ids[j], -sims[i, j], i))
                i, j = i[order], j[order]
                begin = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(q)))])[i]
                keep = np.arange(len(i)) - begin < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(ids[j]), pa.array(sims[i, j])], ["q", "id", "sim"])

    return met.mapInArrow(run, f"q {kind}, id {kind}, sim double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "sim")


def reached(index: Balls, inside: DataFrame, *, k: int) -> DataFrame:
    """(cell, q, v, floor): the other cells that each row must still ask, given its k best (q, rank, sim) inside its own."""
    centres, radii, used = index.centres, index.radii, index.slots > 0
    kind, vector = (index.rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    floors = inside.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("sim").alias("floor"))
    rows = index.rows.join(floors, "id", "left").select("id", "v", "cell", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            angle = np.arccos(np.clip(_matrix(batch.column(1)) @ centres.T, -1, 1))
            bound = np.cos(np.maximum(angle - radii, 0))
            ask = (bound + SLACK >= floor[:, None]) & used
            ask[np.arange(len(own)), own] = False
            i, cell = np.nonzero(ask)
            for s in range(0, len(i), 8192):
                at = pa.array(i[s : s + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + 8192].astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at)], ["cell", "q", "v", "floor"])

    return rows.mapInArrow(run, f"cell int, q {kind}, v {vector}, floor double")


def nearest_of_all(index: Balls, *, k: int, block: int = 2048) -> DataFrame:
    """(q, rank, id, sim): exactly the k most similar others of every indexed row; equal ones go by id.

    First every row asks its own cell, which gives the least similarity that still counts; then it asks the cells
    whose bound reaches that. Fewer than k other rows give fewer ranks.
    """
    own = index.rows.select("cell", F.col("id").alias("q"), "v", F.lit(-2.0).alias("floor"))
    inside = materialize(_best(_compared(own, index, k=k, block=block), k), "inside")
    if not len(index.centres):
        return inside
    outside = _compared(reached(index, inside, k=k), index, k=k, block=block)
    return _best(inside.select("q", "id", "sim").unionByName(outside), k)


def augmented(rows: DataFrame, *, k: int, power: int, cells: int = 4096, block: int = 2048) -> DataFrame:
    """(id, v): unit sum of each row of (id, v) and its k nearest others, weighted by similarity ** power.

    Negative similarities weigh nothing. ids are unique; a group to be summed has at most k + 1 vectors.
    """
    index = ball_index(rows, cells=cells, block=block)
    weight = F.pow(F.greatest("sim", F.lit(0.0)), F.lit(power))
    near = nearest_of_all(index, k=k, block=block).select("q", "id", weight.alias("w"))
    own = index.rows.select(F.col("id").alias("q"), F.lit(1.0).alias("w"), "v")
    parts = near.join(index.rows.select("id", "v"), "id").select("q", "w", "v").unionByName(own)
    scaled = parts.select("q", F.transform("v", lambda x: F.col("w") * x.cast("double")).alias("v"))
    held = scaled.groupBy("q").agg(F.collect_list("v").alias("held"))
    total = F.aggregate(F.slice("held", F.lit(2), F.size("held")), F.col("held")[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return held.select(F.col("q").alias("id"), V.unit(total).alias("v"))
