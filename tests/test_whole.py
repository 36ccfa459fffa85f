"""Operators against plain Python over small random data, and plans that must not gather a table in one task."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import entity, ledger, matching, ordering, recommend, search, taste
from larkspur.plans import registry

FEATURES = [(f"{k}:{i}", k) for k in ("color", "taste", "grape") for i in range(4)]


def random_items(rng, n):
    out = []
    for i in range(n):
        held = rng.sample(FEATURES, rng.randint(0, 5))
        x = {f: rng.random() for f in held}
        length = math.sqrt(sum(v * v for v in x.values())) or 1
        out.append((i, rng.choice(["dry", "sweet"]), rng.random(), {f: v / length for f, v in x.items()}))
    return out


def long_rows(vectors):
    return [(key, f, k, x) for key, held in vectors for (f, k), x in held.items()]


@pytest.mark.parametrize("jitter", [0.0, 0.2])
@pytest.mark.parametrize("near", [None, 0.45])
def test_ranked_items(spark, jitter, near):
    rng = random.Random(3)
    items = random_items(rng, 23)
    vectors = taste.packed_vectors(spark.createDataFrame(long_rows([(i, v) for i, _, _, v in items]), "item long, feature string, kind string, x double"), ["item"])
    table = spark.createDataFrame([(i, lv, p) for i, lv, p, _ in items], "item long, level string, prior double").join(vectors, "item", "left")
    people, seeds, told = [], [], {}
    for p in range(9):
        people.append((p, rng.random(), p % 2 == 0, ["dry"], sorted(rng.sample(range(23), 3))))
        for i in rng.sample(range(23), rng.randint(0, 6)):
            seeds.append((p, i, rng.choice([1.0, 0.7, -0.6])))
        if p % 3 == 0:
            told[p] = {f: 1 / math.sqrt(2) for f in rng.sample(FEATURES, 2)}
    held = spark.createDataFrame(seeds, "profile long, item long, w double").join(vectors, "item").withColumn("label", F.lit(None).cast("string"))
    answers = taste.packed_vectors(spark.createDataFrame(long_rows(told.items()), "profile long, feature string, kind string, x double"), ["profile"]).withColumns({"item": F.lit(None).cast("long"), "label": F.lit("told"), "w": F.lit(0.6)})
    profiles = spark.createDataFrame(people, "profile long, confidence double, guard boolean, levels array<string>, seen array<long>")
    both = held.unionByName(answers).withColumn("interest", F.coalesce("label", F.concat(F.lit("i"), (F.col("item") % 3).cast("string"))))
    found = taste.ranked_items(profiles, both, table, k=4, score=taste.feed_score, jitter=jitter, near=near, shard=12, cluster=2, profile_block=3).collect()

    by_id = {i: v for i, _, _, v in items}
    expected = set()
    for p, sure, guard, levels, seen in people:
        rows = []
        for i, level, prior, v in items:
            if i in seen:
                continue
            likes, penalty = [], 0.0
            for q, s, w in seeds:
                if q == p and by_id[s]:
                    sim = sum(x * v.get(f, 0) for f, x in by_id[s].items())
                    if w > 0:
                        likes.append((round(w * round(sim, 9), 12), w, -s, round(sim, 9), f"i{s % 3}"))
                    else:
                        penalty = max(penalty, -w * sim)
            if p in told:
                kinds = {k for _, k in told[p]}
                sub = math.sqrt(sum(x * x for (f, k), x in v.items() if k in kinds))
                sim = round(sum(x * v.get(f, 0) for f, x in told[p].items()) / sub, 9) if sub else 0.0
                likes.append((0.6 * sim, 0, 0, sim, "told"))
            likes.sort(reverse=True)
            interest = likes[0][4] if likes and near is not None and likes[0][0] > 0 and likes[0][3] >= near else "explore"
            values = [round(x[0], 9) for x in likes] + [0, 0]
            mine = max(0.0, values[0] + 0.25 * values[1] - 0.8 * penalty)
            noise = jitter * hashlib.sha256(f"{p}/{i}".encode()).digest()[0] / 255
            rows.append((-round(10 * (sure * mine + (1 - sure) * prior) - 6 * penalty - 3 * (guard and level not in levels) + noise, 6), i, interest))
        for group in {r[2] for r in rows}:
            expected |= {(p, i, -s) for s, i, _ in sorted(r for r in rows if r[2] == group)[:4]}
    assert {(r.profile, r.item) for r in found} == {(p, i) for p, i, _ in expected}
    score = {(p, i): s for p, i, s in expected}
    assert all(abs(r.score - score[r.profile, r.item]) < 2e-6 for r in found)


def plain_pick(rows, n, interests):
    pool = sorted(rows, key=lambda r: (-r["score"], r["item"]))
    sim = lambda a, b: sum(x * b["v"].get(f, 0) for f, x in a["v"].items())
    chosen, capped, alive = [], [], list(pool)
    while alive and len(chosen) < n:
        here = alive
        if interests:
            taken = lambda k: sum(c["interest"] == k for c in chosen)
            share = {r["interest"]: r["share"] for r in pool}
            key = max({r["interest"] for r in alive}, key=lambda k: (share[k] / (taken(k) + 1), k))
            here = [r for r in alive if r["interest"] == key]

        def gain(r):
            repeat = 0 if interests else 0.1 * sum(c["style"] == r["style"] for c in chosen)
            repeat += 0.12 * sum(c["grape"] == r["grape"] for c in chosen) if r["grape"] else 0
            return r["score"] * (1 - 0.35 * max([sim(r, c) for c in chosen], default=0) - repeat)

        best = max(here, key=gain)
        alive.remove(best)
        if best["dup"] in {c["dup"] for c in chosen}:
            continue
        if sum(c["producer"] == best["producer"] for c in chosen) >= 2:
            capped.append(best)
            continue
        chosen.append(best)
    for r in capped:
        if len(chosen) < n and r["dup"] not in {c["dup"] for c in chosen}:
            chosen.append(r)
    return [r["item"] for r in chosen]


@pytest.mark.parametrize("interests", [True, False])
def test_picked(spark, interests):
    rng = random.Random(11)
    shares = {"a": 0.5, "b": 0.3, "explore": 0.2}
    rows = []
    for i, _, _, v in random_items(rng, 40):
        k = rng.choice(list(shares))
        rows.append({"item": i, "score": rng.random(), "interest": k, "share": shares[k], "style": rng.choice("xyz"), "grape": rng.choice(["", "m", "n"]), "producer": rng.choice("pqrst"), "dup": rng.randint(0, 25), "v": {f[0]: x for f, x in v.items()}})
    df = spark.createDataFrame([(1, r["item"], r["score"], r["interest"], r["share"], r["style"], r["grape"], r["producer"], str(r["dup"]), [(hash(f) % 1000003, 0, x) for f, x in r["v"].items()]) for r in rows], "profile long, item long, score double, interest string, share double, style string, grape string, producer string, duplicate_of string, features array<struct<f:long,k:int,x:double>>")
    got = [r["item"] for r in recommend.picked(df, n=9, interests=interests).orderBy("slot").collect()]
    assert got == plain_pick(rows, 9, interests)


def test_vectors_of_empty_cards(spark):
    card = "item long, color string, sweet string, sparkling boolean, grapes array<string>, words array<string>, dishes array<string>, region string, winery string, alcohol double, temperature double, axes map<string,double>, aromas array<string>"
    rows = taste.item_vectors(spark.createDataFrame([(1, *[None] * 12), (2, "red", None, True, ["g", "g", ""], None, [], "", "w", 11.0, None, {"body": 1.0}, None)], card)).collect()
    assert {r.item for r in rows} == {2} and abs(sum(r.x**2 for r in rows) - 1) < 1e-9
    assert {r.feature for r in rows} == {"color:red", "sparkling:yes", "grape:g", "winery:w", "alc:light", "taste:body:lo"}


def test_blocked_search(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6))
    v[7] = v[9] = v[20]  # ties
    owner = [int(x) for x in rng.integers(0, 5, 40)]
    refs = spark.createDataFrame([(k, owner[k], v[k].tolist()) for k in range(40)], "id long, owner int, v array<double>")
    asked = refs.where("id < 11")
    sims = np.round(v @ v.T, 6)
    for foreign in (False, True):
        got = {(r.q, r["rank"]): (r.id, r.sim) for r in search.blocked_topk(asked, refs, k=3, foreign=foreign, block=7).collect()}
        for q in range(11):
            order = sorted((k for k in range(40) if k != q and not (foreign and owner[k] == owner[q])), key=lambda k: (-sims[q, k], k))[:3]
            assert [got[q, n + 1][0] for n in range(3)] == order
    best = {(r.q, r.owner): r.score for r in search.owner_scores(asked, refs, block=7).collect()}
    assert best == {(q, o): max(sims[q, k] for k in range(40) if owner[k] == o and k != q) for q in range(11) for o in set(owner) if any(owner[k] == o and k != q for k in range(40))}


@pytest.mark.parametrize("block", [3, 2048])
def test_kept_apart(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    v = centres[rng.integers(0, 6, 90)] + rng.normal(scale=0.45, size=(90, 16))
    v[40:60] = v[3]  # copies, more than a block holds
    owner = [1 if k % 3 else int(rng.integers(0, 4)) for k in range(90)]  # one owner holds most rows
    apart = lambda a, b: ((v[a] > 0) != (v[b] > 0)).sum() > 4 or round(float(np.sqrt(((v[a] - v[b]) ** 2).mean())), 6) >= 0.7
    kept = []
    for k in range(90):
        if all(apart(k, j) for j in kept if owner[j] == owner[k]):
            kept.append(k)
    rows = [(k, owner[k], v[k].tolist()) for k in range(90)] + [(90, None, v[3].tolist()), (91, 1, None), (92, None, None)]
    refs = spark.createDataFrame(rows, "id long, owner int, v array<double>")
    assert sorted(r.id for r in search.kept_apart(refs, bits=4, rmse=0.7, block=block).collect()) == [*kept, 90, 91, 92]
    near = {(a, b) for a in range(90) for b in range(a + 1, 90) if owner[a] == owner[b] and not apart(a, b)}
    found = [(r.a, r.b) for r in search.near_in_groups(refs, bits=4, rmse=0.7, block=block).collect()]
    assert near <= set(found) and set(found) == near and 10 < len(kept) < 70
    assert search.kept_apart(refs.where("false"), bits=4, rmse=0.7).count() == 0


def test_first_independent(spark):
    rng = random.Random(2)
    for _ in range(4):
        pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)}
        kept = []
        for k in range(25):
            if not any((j, k) in pairs for j in kept):
                kept.append(k)
        nodes = spark.range(25)
        got = ordering.first_independent(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"))
        assert sorted(r.id for r in got.collect()) == kept


def test_positions_and_percentiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9)), k) for k in range(57)] + [("c", 1.0, 99)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    assert [r.i for r in ordering.positions(df, [F.desc("v"), F.col("i")]).orderBy("pos").collect()] == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    for r in ordering.percentiles(df, key="k", value="v", ties=["i"], q=0.95).collect():
        held = sorted(v for k, v, _ in rows if k == r.k)
        assert abs(r.linear - np.percentile(held, 95)) < 1e-9
        assert (r.by_index, r.by_count) == (held[int(0.95 * (len(held) - 1))], held[min(int(0.95 * len(held)), len(held) - 1)])


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


def test_token_ratios(spark):
    rng = random.Random(9)
    words = ["red", "reds", "ring", "rings", "bolt", "blot", ""]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    for r in df.select("a", "b", matching.token_sort_ratio("a", "b").alias("sort"), entity.token_set_ratio("a", "b").alias("set")).collect():
        assert abs(r.sort - plain_ratio(*(" ".join(sorted(t.split())) for t in (r.a, r.b)))) < 1e-9
        x, y = set(r.a.split()), set(r.b.split())
        both, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if not x or not y:
            want = 0.0
        elif both and (not p or not q):
            want = 100.0
        else:
            want = max(plain_ratio(c, d) for c, d in ((both, f"{both} {p}".strip()), (both, f"{both} {q}".strip()), (f"{both} {p}".strip(), f"{both} {q}".strip())) if both or c != both)
        assert abs(r.set - want) < 1e-9, (r.a, r.b)


def test_cascade(spark):
    wanted = spark.createDataFrame([("s1", "red_ring_one", "pic_one"), ("s2", "old_bolt_two", None), ("s3", "red_ring_on", None), ("s4", "old_bolt_zzzzzzzz", None), ("s5", "none_such", None), ("s6", "junk_file_x", None)], "slug string, key string, photo string")
    bases = spark.createDataFrame([("pic_One_base", "pic_one", True), ("old_bolt_two", "old_bolt_two", True), ("ring_red_one", "ring_red_one", True), ("junk_file_x", "junk_file_x", False)], "base string, file_key string, usable boolean")
    got = {r.slug: (r.base, r.method) for r in entity.cascade(wanted, bases).collect()}
    assert got == {"s1": ("pic_One_base", "column"), "s2": ("old_bolt_two", "exact"), "s3": ("ring_red_one", "fuzzy"), "s4": ("old_bolt_two", "unresolved"), "s5": (None, "unresolved"), "s6": ("junk_file_x", "unresolved")}


def test_ledger_undoes_once(spark):
    rows = [(1, "a", "r1", 5, None), (2, "a", "r1", 5, None), (3, "a", "u1", 0, 1), (4, "a", "u2", 0, 1), (5, "a", "r2", -1, None), (6, "a", "u3", 0, 99)]
    got = ledger.balances(spark.createDataFrame(rows, "id long, account string, request string, delta long, undo_of long")).orderBy("id").collect()
    assert [(r.id, r.delta, r.balance, r.valid, r.undone) for r in got] == [(1, 5, 5, True, True), (3, -5, 0, True, False), (5, -1, -1, False, False)]


@pytest.mark.parametrize("name", ["round_robin_host", "entity_folds", "stratified_sample", "search_order", "grouped_split", "percentiles", "filtered_page", "popularity_topn", "dhondt_feed", "swipe_deck", "popularity_prior"])
def test_no_table_in_one_task(spark, sf_dir, name, capsys):
    """Only partial aggregates and limits go to a single partition."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    for line, below in zip(plan, plan[1:]):
        if "Exchange SinglePartition" in line:
            assert any(x in below for x in ("HashAggregate", "SortAggregate", "LocalLimit", "GlobalLimit", "TakeOrdered")), below
