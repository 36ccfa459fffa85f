import random
from collections import Counter, defaultdict

import pytest

from larkspur.llm import components, near_dups
from larkspur.llm.near_dups import near_duplicates, shingle_set


def brute(texts):
    """(set size, smallest id reachable) of each text by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        texts += [" ".join(base)] + [edited(rng, base, rng.randrange(0, 5)) for _ in range(rng.randrange(0, 4))]
    big = [rng.choice(vocabulary) for _ in range(150)]
    texts += [edited(rng, big, rng.randrange(0, 6)) for _ in range(40)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(10, 80))]) for _ in range(40)]
    return texts


def test_components_by_brute_force(make):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make(texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_prefix_round_alone_finds_all_links(spark, make):
    """The exact round, given one group of everything and no link, confirms every link."""
    texts = corpus(2)
    memo = near_dups._WordHashes()
    sets = {i: shingle_set(t, memo).view("int64").tolist() for i, t in enumerate(texts)}
    distinct = {tuple(s): i for i, s in reversed(list(sets.items()))}
    rows = [(i, list(s)) for s, i in distinct.items()]
    keys = spark.createDataFrame([(0, i, len(s)) for i, s in rows], "key long, doc_id long, n long")
    links = near_dups._finish(keys, spark.createDataFrame(rows, "doc_id long, shingles array<long>"), spark.createDataFrame([], "u long, v long"))
    found = {tuple(sorted((r.u, r.v))) for r in links.collect()}
    wanted = set()
    for a, x in rows:
        for b, y in rows:
            common = len(set(x) & set(y))
            if a < b and 100 * common >= 75 * (len(x) + len(y) - common):
                wanted.add((a, b))
    assert found == wanted


def test_awkward_rows(make, awkward):
    docs = make(awkward)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(awkward))] == [(n, c) for n, c in brute([a if not isinstance(a, tuple) else a[0] for a in awkward])]
    assert near_dups.deduplicate(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == near_dups.deduplicate(docs.limit(0)).count() == 0
    repeated = make(["a b c d e f", "a b c d e f", "z"], ids=[7, 7, None])
    assert sorted((r.doc_id or 0, r.kept) for r in near_duplicates(repeated).collect()) == [(0, True), (7, True), (7, True)]


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "u long, v long")
    assert {(r.node, r.component) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(301, 300)}
