"""The rule-based feed: affinity counts of what a profile rated high, and picks whose scores fall with each pick of a producer."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.selection import top_per_group
from larkspur.storage import materialize

# What each kind of affinity counts, its cap, what a high rating adds, what a repeated producer costs.
SHARES = {"category": 0.45, "producer": 0.9, "grape": 0.65}
PER_RATING, CAP, RATED_HIGH, REPEAT = 3, 9, 3.0, 4.0


def picks(scores: np.ndarray, producers: np.ndarray, n: int) -> list[tuple[float, int]]:
    """(score less its penalty, place) of the n picks among items in order of preference at equal scores.

    A heap holds each item at a score that was right when it was pushed; a popped item whose producer was picked since is
    corrected and pushed again, so only items near the top are ever corrected.
    """
    heap = [(-s, -s, i) for i, s in enumerate(scores.tolist())]
    heapq.heapify(heap)
    taken, out = Counter(), []
    while heap and len(out) < n:
        gain, score, i = heapq.heappop(heap)
        right = score + REPEAT * taken[producers[i]]
        if right != gain:
            heapq.heappush(heap, (right, score, i))
            continue
        taken[producers[i]] += 1
        out.append((-gain, i))
    return out


def feed(ratings: DataFrame, items: DataFrame, *, n: int, shard: int = 1 << 15, profile_block: int = 1024) -> DataFrame:
    """(profile, slot, item, score): n picks for each profile of ratings (profile, item, rating) among items (item, name, category, producer, grape).

    Items equal in category, producer and grape are a class of one score. A class keeps its first items by name, n more than any
    profile has rated in it, so n unrated ones are among them; what a profile rated high comes with the profile. Classes are dealt
    by producer, so each shard's penalties are its own and the n best of all shards' picks are the picks among all items. A task
    holds one shard and streams blocks of profiles past it; classes of a producer stay together, in one shard.
    """
    kind_of = ["category", "producer", "grape"]
    known = materialize(ratings.where("rating >= 4 or rating <= 2").join(items, "item"), "known")
    liked = known.where("rating >= 4")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in SHARES]))
    counts = liked.select("profile", named.alias("a")).where("a.value IS NOT NULL").groupBy("profile", "a").agg((F.count("*") * PER_RATING).alias("x"))
    affinity = counts.groupBy("profile").agg(F.collect_list(F.struct("a.kind", "a.value", "x")).alias("affinity"))
    rated = known.groupBy("profile").agg(F.collect_list(F.struct("item", (F.col("rating") >= 4).alias("high"), "name", *kind_of)).alias("known"))
    people = ratings.select("profile").distinct().join(affinity, "profile", "left").join(rated, "profile", "left")
    most = known.groupBy("profile", *kind_of).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    first = materialize(top_per_group(items.select("item", "name", *kind_of), kind_of, ["name", "item"], n + most), "first")
    n_shards, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((first, shard), (people, profile_block)))
    cores = ratings.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(n_blocks, 2 * cores)
    lanes = min(n_blocks, max(1, 2 * cores // n_shards))
    held = first.groupBy(F.pmod(F.xxhash64("producer"), F.lit(n_shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("name", "item", *kind_of))).alias("items"))
    blocks = people.groupBy(F.pmod(F.xxhash64("profile"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("profile", "affinity", "known")).alias("people"))
    counted = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    asked = blocks.select(counted(n_shards).alias("shard"), F.pmod("block", F.lit(lanes)).alias("lane"), (F.col("block") + 1).alias("seq"), "people")
    rows = held.select("shard", counted(lanes).alias("lane"), F.lit(0).cast("long").alias("seq"), "items").unionByName(asked, allowMissingColumns=True)
    dealt = rows.repartition(2 * n_shards * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "seq").select("seq", "items", "people", "shard")
    who, kind = ratings.schema["profile"].dataType.simpleString(), items.schema["item"].dataType.simpleString()

    def run(batches):
        catalogue = shard = None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() == 0:
                    catalogue, shard = _Catalogue(batch.column(1).slice(row, 1).flatten()), batch.column(3)[row]
                elif shard == batch.column(3)[row]:  # a shard may be without items
                    people = batch.column(2).slice(row, 1).flatten()
                    found = [(p, *x) for p, one in enumerate(people.to_pylist()) for x in catalogue.picked(one, n)]
                    yield pa.RecordBatch.from_arrays(
                        [people.field(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[2] for f in found], catalogue.kind), pa.array([f[1] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.string())],
                        ["profile", "item", "gain", "score", "name"],
                    )

    local = dealt.mapInArrow(run, f"profile {who}, item {kind}, gain double, score double, name string")
    order = [F.desc("gain"), F.desc("score"), "name", "item"]
    best = top_per_group(local, ["profile"], order, n, place="slot")
    return best.select("profile", "slot", "item", F.col("gain").alias("score"))


class _Catalogue:
    """The first items of classes, by class; classes by producer."""

    def __init__(self, rows: pa.StructArray):
        self.kind = rows.type.field(1).type
        items = list(zip(rows.field(0).to_pylist(), rows.field(1).to_pylist(), strict=True))
        values = [[str(x) for x in rows.field(i).to_pylist()] for i in (2, 3, 4)]  # category, producer, grape
        held: dict[tuple, list] = {}
        for item, category, producer, grape in zip(items, *values, strict=True):
            held.setdefault((producer, category, grape), []).append(item)
        self.keys = sorted(held)
        self.items = [held[k] for k in self.keys]
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.size = np.array([len(x) for x in self.items])
        self.codes = {k: np.unique(np.array([key[i] for key in self.keys]), return_inverse=True) for i, k in ((1, "category"), (0, "producer"), (2, "grape"))}
        self.names = {k: {x: i for i, x in enumerate(values)} for k, (values, _) in self.codes.items()}
        self.begins = np.searchsorted(self.codes["producer"][1], np.arange(len(self.codes["producer"][0])))

    def picked(self, person: dict, n: int):
        """(gain, item, score, name) of n picks: only classes that reach the n-th of the producers' best scores are opened."""
        parts = {k: np.zeros(len(self.names[k])) for k in SHARES}
        for a in person["affinity"] or []:
            at = self.names[a["kind"]].get(str(a["value"]))
            if at is not None:
                parts[a["kind"]][at] = min(a["x"], CAP) * SHARES[a["kind"]]
        total = np.zeros(len(self.keys))
        for kind in SHARES:
            total += parts[kind][self.codes[kind][1]]
        left, rated, offered = self.size.copy(), set(), []
        for k in person["known"] or []:
            c = self.place.get((str(k["producer"]), str(k["category"]), str(k["grape"])))
            if c is not None:  # of this shard
                left[c] -= 1
                rated.add(k["item"])
                if k["high"]:
                    offered.append((-round(total[c] + RATED_HIGH, 6), k["name"], k["item"], self.keys[c][0]))
        total = np.round(total, 6)
        best = np.maximum.reduceat(np.where(left > 0, total, -np.inf), self.begins)
        least = np.partition(best, -n)[-n] if len(best) >= n else -np.inf
        by_producer: dict[str, list] = {}
        for c in np.flatnonzero(total >= least).tolist():
            # an r-th pick of a producer costs its earlier ones and has to reach the bound all the same
            score, open_, most = -float(total[c]), 0, min(n, 1 + (total[c] - least + 1e-9) // REPEAT)
            for name, item in self.items[c]:
                if item not in rated:
                    by_producer.setdefault(self.keys[c][0], []).append((score, name, item))
                    open_ += 1
                    if open_ >= most:
                        break
        for score, name, item, producer in offered:
            by_producer.setdefault(producer, []).append((score, name, item))
        rows = []
        for producer, found in by_producer.items():
            found.sort(key=_order)
            rows += [(*x, producer) for x in found[:n]]
        rows.sort(key=_order)
        return [(gain, rows[i][2], -rows[i][0], rows[i][1]) for gain, i in picks(np.array([-x[0] for x in rows]), [x[3] for x in rows], n)]


def _order(row: tuple):
    """By score, name and item, a null name first."""
    return row[0], row[1] is not None, row[1] or "", row[2]
