"""Equal ids and sizes in the mix, and shingle sets that cross the chunks in which they are hashed."""

from larkspur.llm import mixing, near_dups


def test_equal_ids_and_sizes_mix_alike_on_reruns(make):
    rows = [(f"{w} b c", "en", "s0") for w in ("x", "y", "z", "x")] + [("d e f g", "en", "s1")] * 2
    docs = make(rows, ids=[1, 1, 1, 1, 2, 2])
    runs = []
    for n in (1, 3, 6):
        plan = mixing.mixing_plan(docs.repartition(n), carry=True).select("doc_id", "row.text", "begin", "taken").collect()
        runs.append(sorted((r.doc_id, r.text, r.begin, r.taken) for r in plan))
    assert runs[0] == runs[1] == runs[2]


def test_sets_beyond_one_chunk(make):
    words = [f"w{i}" for i in range(9000)]
    close = [w if i % 50 else f"other{i}" for i, w in enumerate(words)]
    far = [w if i % 12 else f"other{i}" for i, w in enumerate(words)]
    docs = make([" ".join(words), " ".join(close), " ".join(far), " ".join(reversed(words))])
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, close, far, words[::-1])]
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert similar(0, 1) and not similar(0, 2) and not similar(1, 2) and not similar(0, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == {0: (len(sets[0]), 0), 1: (len(sets[1]), 0), 2: (len(sets[2]), 2), 3: (len(sets[3]), 3)}
