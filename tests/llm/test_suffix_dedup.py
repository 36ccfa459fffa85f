import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import bwt
from larkspur.llm.suffix_dedup import repeated_substrings


def starts(strings, least):
    seen = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
    return [[i for i in range(len(s) - least + 1) if seen[s[i : i + least]] > 1] for s in strings]


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    out = []
    for d, at in zip(data, starts(data, least), strict=True):
        gone = {j for i in at for j in range(i, i + least)}
        spans = sum(j - 1 not in gone for j in gone)
        out.append((len(d), len(gone), spans, hashlib.sha256(bytes(b for j, b in enumerate(d) if j not in gone)).hexdigest()))
    return out


def test_repeated_starts():
    rng = random.Random(5)
    for _ in range(150):
        sigma, least = rng.choice([1, 2, 3, 10, 255]), rng.randint(1, 12)
        strings = [bytes(rng.randint(0, sigma) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            strings += [strings[0], strings[0][3:20] + b"x" + strings[-1]]
        assert [x.tolist() for x in bwt.repeated_starts(strings, least)] == starts(strings, least)


@pytest.mark.parametrize(("least", "group"), [(8, 4 << 20), (8, 64), (20, 100), (40, 1)])
def test_removed_bytes_by_brute_force(make, awkward, least, group):
    rng = random.Random(least)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], "xy" * 50, *[texts[5][:30] + "q" + texts[5][30:]] * 3, "é" * 40]
    texts += [a if not isinstance(a, tuple) else a[0] for a in awkward if a is None or len(a) < 1000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeated_substrings(make(texts), least=least, group=group).collect()}
    assert got == dict(enumerate(brute(texts, least)))


def test_rows_that_share_an_id(make):
    same, other = "abcdefghij" * 3, "0123456789" * 3
    rows = repeated_substrings(make([same, same, other + "z", None], ids=[1, 1, 1, None]), least=25).collect()
    assert sorted(r.n_removed for r in rows) == sorted(x[1] for x in brute([same, same, other + "z", None], 25))


def test_empty_table(make):
    assert repeated_substrings(make(["a"]).limit(0)).count() == 0


def test_long_texts_cut_in_pieces(make, monkeypatch):
    from larkspur.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(9)
    data = [rng.randbytes(400), rng.randbytes(90)]
    data += [data[0][:150] + data[1] + data[0][130:]]
    for d in data:  # the runs of windows that pieces give are those of the whole
        runs = suffix_dedup.anchored_runs(__import__("numpy").frombuffer(d, "uint8"), 20, 8)
        windows = [w for a, b in zip(runs[1], runs[2], strict=True) for w in range(a, b + 1)]
        assert windows == list(range(len(d) - 19))
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(3)]
    texts += [texts[0][:140] + "c" + texts[1][20:] + texts[0]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeated_substrings(make(texts), least=20).collect()}
    assert got == dict(enumerate(brute(texts, 20)))


def test_passages(make):
    words = [f"w{k}" for k in range(300)]
    long, short = " ".join(words[:60]), " ".join(words[100:140])
    texts = ["a b c " + long + " d", "x " + long, "y " + short + " z", short, "q r s", None]
    rows = {r.doc_id: (r.n_removed, r.n_passages) for r in repeated_substrings(make(texts), least=400, passage=(100, 50)).collect()}
    assert rows == {0: (0, 1), 1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_suffix_array_sorts_by_triples_of_ranks():
    rng = random.Random(11)
    for _ in range(60):
        strings = [bytes(rng.randint(0, rng.choice([0, 1, 255])) for _ in range(rng.choice([0, 3, 6, 7, 8, 60, 200]))) for _ in range(rng.randint(1, 8))]
        strings += [strings[0], strings[0] * 2, strings[-1][2:]]
        symbols, suffixes, at = [], [], 0
        for k, s in enumerate(strings):  # suffixes of equal bytes go by their strings
            suffixes += [([b + 1 for b in s[i:]] + [0], k, at + i) for i in range(len(s) + 1)]
            symbols += [b + 1 for b in s] + [0]
            at += len(s) + 1
        assert bwt.suffix_array(np.array(symbols, np.int16)).tolist() == [x[2] for x in sorted(suffixes)]


def test_texts_anchored_together_as_each_alone(monkeypatch):
    from larkspur.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "TOGETHER", 200)
    rng = random.Random(12)
    texts = [rng.randbytes(rng.choice([0, 1, 19, 20, 21, 90, 300])) for _ in range(60)] + [b"", b"a" * 199, b"b"]
    for part in (texts, texts[:1], [b""], []):
        alone = [(k, *x) for k, t in enumerate(part) for x in zip(*map(np.ndarray.tolist, suffix_dedup.anchored_runs(np.frombuffer(t, np.uint8), 20, 8)), strict=True)]
        assert list(zip(*map(np.ndarray.tolist, suffix_dedup.anchored_texts(part, 20, 8)), strict=True)) == alone


def test_suffix_array_stops_at_a_depth():
    rng = np.random.default_rng(3)
    for depth in (1, 5, 6, 15, 40):
        strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 1, 4, 5, 6, 90)] + [b"ab" * 60, b"ab" * 60]
        symbols = np.array([c for s in strings for c in [*(b + 1 for b in s), 0]], np.int16)
        heads = [tuple(symbols[k : k + depth].tolist()) for k in bwt.suffix_array(symbols, depth)]
        heads = [h[: h.index(0) + 1] if 0 in h else h for h in heads]
        assert heads == sorted(heads) and len(heads) == len(symbols)


def test_one_survey_lists_the_anchors_of_both_widths(make, monkeypatch):
    from larkspur.llm import suffix_dedup

    surveys, surveyed = [], suffix_dedup._surveyed

    def counted(widths):
        surveys.append(widths)
        return surveyed(widths)

    monkeypatch.setattr(suffix_dedup, "_surveyed", counted)
    shared = " ".join(f"w{k}" for k in range(30))
    texts = [f"one {shared} two", f"three {shared} four", "short", None, f"one {shared} two"]
    found = {r.doc_id: r for r in suffix_dedup.repeated_substrings(make(texts), least=400, passage=(32, 20)).collect()}
    assert surveys == [[(400, 32), (32, 16)]]
    assert [found[k].n_passages for k in range(5)] == [1, 1, 0, 0, 1] and not any(r.n_removed for r in found.values())
