import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import digests
from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.operators import graph, matching, search


def test_components_against_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    found = graph.connected_components(spark.createDataFrame(edges, "u long, v long"), nodes=nodes).collect()
    assert {r.node: r.component for r in found} == {i: find(i) for i in range(60)}


def test_grouped_split_keeps_components_together(spark):
    parts = spark.createDataFrame([(i, i // 4) for i in range(80)], "node long, component long")
    rows = graph.grouped_split(parts).collect()
    assert len({(r.component, r.split) for r in rows}) == 20
    assert sorted(sum(r.split == s for r in rows) // 4 for s in ("test", "validation", "train")) == [3, 3, 14]


def test_few_components_all_train(spark):
    rows = graph.grouped_split(spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")).collect()
    assert {r.split for r in rows} == {"train"}


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    random.seed(1)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randrange(12))) for _ in range(2))
        assert matching.common_subsequence(a, b) == plain(a, b)


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["red", "rod", "bolt", "bold", "ring", "rings", "gear", "a", "anvil", "x"]
    rows = [(i, rng.choice("pq"), " ".join(rng.sample(words, rng.randint(0, 3)))) for i in range(160)]
    found = matching.similar_names(spark.createDataFrame(rows, "id long, brand string, name string"), block="brand", key="id", text="name", least=75).collect()
    classes = {}
    for i, b, t in rows:
        classes.setdefault((b, " ".join(sorted(t.split()))), []).append(i)
    want = {(min(ids), i) for ids in classes.values() for i in ids if i != min(ids)}
    for (b, s), x in classes.items():
        for (c, t), y in classes.items():
            if b == c and min(x) < min(y) and 200 * matching.common_subsequence(s, t) >= 75 * (len(s) + len(t)):
                want.add((min(x), min(y)))
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_unit_of_zero_vector(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(V.unit("a").alias("a"), V.unit("b").alias("b"), V.norm("a").alias("n")).first()
    assert row.a == pytest.approx([0.6, 0.8]) and row.b == [0.0, 0.0] and row.n == 5.0


def test_blocked_topk_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {(r.q, r["rank"]): r.id for r in search.blocked_topk(df.where("id < 5"), df, k=3, block=16).collect()}
    for q in range(5):
        sims = np.round(x @ x[q], 6)
        sims[q] = -np.inf
        assert [found[q, k] for k in (1, 2, 3)] == np.argsort(-sims, kind="stable")[:3].tolist()


def test_whitening_gives_unit_variance(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)) @ np.diag([5, 3, 1, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    y = np.stack([r.v for r in search.whitened(df, k=3).collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(3), atol=1e-6)


def test_bootstrap_brackets_mean(spark):
    row = search.bootstrap_mean(spark.range(500).select(F.xxhash64("id").alias("h"), F.col("id").cast("double").alias("x")), rounds=100).first()
    assert row.low < 249.5 < row.high and row.high - row.low < 80


def test_bootstrap_draws_each_row_anew_in_each_round(spark):
    xs, rounds = [float(i * i % 37) for i in range(60)] + [None], 50

    def times(h, r):
        u = (int(hashlib.md5(f"{h}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        return sum(u > limit for limit in search.POISSON)

    means = []
    for r in range(1, rounds + 1):
        n = [times(i, r) if x is not None else 0 for i, x in enumerate(xs)]
        means.append(sum(x * k for x, k in zip(xs, n, strict=True) if k) / sum(n))
    row = search.bootstrap_mean(spark.createDataFrame(list(enumerate(xs)), "h long, x double"), rounds=rounds).first()
    assert np.allclose([row["mean"], row.low, row.high], [np.mean(means), *np.percentile(means, [2.5, 97.5])], atol=1e-9)


def test_ngrams_of_three_to_five(spark):
    def grams(word):
        w = f" {word} "
        return {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)} or {w}

    words = ["a", "ab", "abc", "abcdef"]
    found = matching.ngram_weights(spark.createDataFrame(list(enumerate(words)), "id long, text string"), most=5).collect()
    assert {i: {r.gram for r in found if r.id == i} for i in range(4)} == {i: grams(w) for i, w in enumerate(words)}


def test_tables_of_words_and_phrases(spark):
    df = spark.createDataFrame([("Château Pinot Noir, Cabernet Sauvignon Brut Reserve",)], "t string")
    row = df.select(T.folded(F.col("t"), T.FOLDED_WORDS).alias("folded"), T.translated(F.col("t"), T.TRANSLATED_PHRASES, "a-zâа-я0-9").alias("translated")).first()
    assert row.folded == "shato pino nuar kaberne sovinon bryut rezerv"
    assert row.translated == "château пино нуар каберне совиньон брют резерв"


def test_digests_of_any_length():
    rng = np.random.default_rng(0)
    for size in (0, 1, 3, 4, 13, 51, 54, 55, 60):
        names = rng.integers(0, 256, (5, size)).astype(np.uint8)
        for suffix in (b":1", b":37", b":200"):
            want = [int.from_bytes(hashlib.md5(name.tobytes() + suffix).digest()[:4], "big") for name in names]
            assert digests.first_bits(names, size, suffix).tolist() == want


def test_bootstrap_makes_no_row_a_draw(spark):
    row = search.bootstrap_mean(spark.range(3000).select("id", F.lit(1.0).alias("x")).withColumnRenamed("id", "h"), rounds=20)
    assert "Generate" not in row._jdf.queryExecution().optimizedPlan().toString() and row.first()["mean"] == 1.0
