"""Neighbours of all rows through balls against all pairs."""

import numpy as np
import pytest

from larkspur.operators import balls


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>")


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def all_pairs(x, k):
    sims = np.round(x @ x.T, 6)
    out = set()
    for q in range(len(x)):
        others = sorted((-sims[q, r], r) for r in range(len(x)) if r != q)
        out |= {(q, n + 1, r, round(-s, 6)) for n, (s, r) in enumerate(others[:k])}
    return out


def clustered(rng, clusters, size, width):
    middle = units(rng.normal(size=(clusters, width)))
    return units(np.repeat(middle, size, axis=0) + rng.normal(scale=0.02, size=(clusters * size, width)))


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_equal_to_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = {"random": lambda: units(rng.normal(size=(150, 8))), "clustered": lambda: clustered(rng, 10, 20, 16), "copies": lambda: np.repeat(units(rng.normal(size=(12, 4))), 9, axis=0)}[kind]()
    index = balls.ball_index(frame(spark, x), block=32)
    got = balls.nearest_of_all(index, k=3, block=16).collect()
    assert {(r.q, r["rank"], r.id, round(r.sim, 6)) for r in got} == all_pairs(x, 3)
    assert len(got) == 3 * len(x)


def test_clusters_are_skipped(spark):
    x = clustered(np.random.default_rng(5), 20, 30, 32)
    index = balls.ball_index(frame(spark, x), block=64)
    inside = balls._best(balls._compared(index.rows.selectExpr("cell", "id AS q", "v", "-2.0D AS floor"), index, k=3, block=64), 3)
    asked = balls.reached(index, inside, k=3).count()
    assert asked < 0.2 * len(x) * (index.slots > 0).sum()


def test_augmented_sums(spark):
    x = units(np.random.default_rng(8).normal(size=(60, 6)))
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -np.inf)
    want = np.empty_like(x)
    for q in range(len(x)):
        near = np.argsort(-sims[q], kind="stable")[:2]
        want[q] = x[q] + np.maximum(sims[q, near], 0) ** 3 @ x[near]
    got = {r.id: r.v for r in balls.augmented(frame(spark, x), k=2, power=3, block=16).collect()}
    assert len(got) == len(x)
    assert np.allclose(np.array([got[i] for i in range(len(x))]), units(want), atol=1e-6)


def test_few_rows_and_none(spark):
    one = balls.augmented(frame(spark, [[0.6, 0.8]]), k=2, power=3).collect()
    assert [(r.id, [round(c, 6) for c in r.v]) for r in one] == [(0, [0.6, 0.8])]
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert balls.augmented(empty, k=2, power=3).collect() == []
    holes = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "id long, v array<double>")
    assert [r.id for r in balls.augmented(holes, k=2, power=3).collect()] == [1]
