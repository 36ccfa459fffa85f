"""Index search and the rule-based feed against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from larkspur.operators import classic, text_index


@pytest.mark.parametrize("size", [4, 64])
def test_index_search_reads_few_blocks(spark, size):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, [12 - j for j in range(12)], k=rng.randint(0, 7))
        rows.append((i, rng.randint(0, 40), f"n{i % 7}", words, words[: rng.randint(0, 2)] if i % 11 else None))
    docs = spark.createDataFrame(rows, "id long, fit int, name string, words array<string>, title array<string>")
    asked = [(q, rng.sample(vocabulary, rng.randint(1, 3))) for q in range(20)] + [(20, ["absent"]), (21, []), (22, ["w0", "w0"])]
    postings, places = text_index.index(docs, size=size)
    got = text_index.search(postings, places, spark.createDataFrame(asked, "q long, words array<string>"), k=5, size=size).collect()
    for q, words in asked:
        held = [(-sum(w in (t or []) for w in set(words)), -fit, name, i) for i, fit, name, ws, t in rows if words and set(words) <= set(ws)]
        want = [(p + 1, x[3], -x[0]) for p, x in enumerate(sorted(held)[:5])]
        assert sorted((r.pos, r.id, r.hits) for r in got if r.q == q) == want
    if size == 4:
        counts = {r.q: (r.n_read, r.n_blocks) for r in got}
        assert sum(a for a, _ in counts.values()) < 0.6 * sum(b for _, b in counts.values())
    assert text_index.search(postings, places, spark.createDataFrame([(1, ["absent"])], "q long, words array<string>"), k=5, size=size).count() == 0


def plain_picks(scores, producers, n):
    left, taken, out = list(range(len(scores))), Counter(), []
    while left and len(out) < n:
        best = max(left, key=lambda i: scores[i] - 4 * taken[producers[i]])  # the first of equals
        left.remove(best)
        out.append((scores[best] - 4 * taken[producers[best]], best))
        taken[producers[best]] += 1
    return out


def test_lazy_heap_equals_a_plain_loop():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(0, 30)
        scores = sorted((rng.choice([0.0, 1.35, 2.7, 4.0, 8.0, 9.5]) for _ in range(n)), reverse=True)
        producers = [rng.randint(0, 4) for _ in range(n)]
        assert classic.picks(np.array(scores), np.array(producers), 8) == plain_picks(scores, producers, 8)


@pytest.mark.parametrize("shard", [7, 1000])
def test_classic_feed(spark, shard):
    rng = random.Random(2)
    items = [(i, f"name {rng.randint(0, 9)}", rng.choice(["red", "white", None]), rng.choice("pqrst"), rng.choice(["g", "h"])) for i in range(40)]
    ratings = [(p, i, rng.randint(1, 5)) for p in range(12) for i in rng.sample(range(40), rng.randint(1, 9))]
    got = classic.feed(spark.createDataFrame(ratings, "profile long, item long, rating int"), spark.createDataFrame(items, "item long, name string, category string, producer string, grape string"), n=8, shard=shard, profile_block=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.profile, []).append((r.slot, r.item, round(r.score, 6)))
    for p in range(12):
        own = {i: s for q, i, s in ratings if q == p}
        if not own:
            continue
        counts = Counter((k, items[i][c]) for i, s in own.items() if s >= 4 for c, k in ((2, "category"), (3, "producer"), (4, "grape")) if items[i][c] is not None)
        scored = []
        for i, name, *attributes in items:
            if own.get(i, 3) > 2:
                score = sum(min(3 * counts[k, v], 9) * classic.SHARES[k] for k, v in zip(("category", "producer", "grape"), attributes, strict=True)) + 3 * (own.get(i, 0) >= 4)
                scored.append((-round(score, 6), name, i, attributes[1]))
        scored.sort()
        want = plain_picks([-s for s, *_ in scored], [x[3] for x in scored], 8)
        assert sorted(by[p]) == [(k + 1, scored[i][2], round(g, 6)) for k, (g, i) in enumerate(want)]


def test_classic_feed_holds_the_first_items_of_classes(spark, monkeypatch):
    held, make = [], classic.top_per_group
    monkeypatch.setattr(classic, "top_per_group", lambda *a, **kw: held.append(make(*a, **kw)) or held[-1])
    items = spark.range(4000).selectExpr("id AS item", "concat('n', id % 3) AS name", "'c' AS category", "concat('p', id % 4) AS producer", "'g' AS grape")
    ratings = spark.createDataFrame([(1, 0, 5), (1, 12, 2), (1, 24, 3), (2, 3999, 1)], "profile long, item long, rating int")
    got = classic.feed(ratings, items, n=8).orderBy("profile", "slot").collect()
    assert held[0].count() == 4 * (8 + 2)  # of 4,000 items: a profile rated two of one class
    # item 0 as the best liked, then the first of names of other producers, an equal gain first by score
    assert [r.item for r in got if r.profile == 1][:1] == [0] and 12 not in [r.item for r in got if r.profile == 1]
    assert [(r.item, r.score) for r in got if r.profile == 2] == [(0, 0.0), (3, 0.0), (6, 0.0), (9, 0.0), (12, -4.0), (15, -4.0), (18, -4.0), (21, -4.0)]
