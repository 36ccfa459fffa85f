import random
from collections import defaultdict

import pytest
from oracle import connect, same

import corpus_pipeline
from larkspur.llm import line_dedup, mixing, quality, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name])


def test_targets_and_taken(make):
    rows = [("w " * (k % 17 + 1), "en", f"s{k % 4}" if k % 9 else None) for k in range(400)]
    plan = mixing.mixing_plan(make(rows)).collect()
    total = sum(r.size for r in plan)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        by[r.source][0] += r.taken
        by[r.source][1:] = [r.target, r.source_size]
        assert 0 <= r.taken <= 2 * r.size
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size


def test_mix_serves_planned_words(make):
    docs = make([("a b c d e f g", "en", "s0"), ("h i j", "en", "s1"), ("k l", "en", "s2"), ("k l", "en", "s2")], ids=[0, 1, 2, 2])
    plan, mix = mixing.mixing_plan(docs).collect(), mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    assert sum(len(r.text.split()) for r in mix.collect()) == sum(r.taken for r in plan)


def test_awkward_rows(make, awkward):
    docs = make(awkward)
    assert mixing.mixing_plan(docs).count() == len(awkward)
    again = [sorted((r.doc_id, r.taken) for r in mixing.mixing_plan(docs.repartition(n)).collect()) for n in (1, 7)]
    assert again[0] == again[1]
    assert mixing.mixing_plan(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_noise(make):
    clean = "\n".join(f"Sentence {k} tells item{k} about place{k}, where river{k} meets hill{k}." for k in range(6))
    menu = "\n".join("Home | About | News | Contact | Login" for _ in range(6)) + "\nOne real sentence stands here alone, with words."
    noise = "\n".join("buy### now$$$ cheap%%% pills&&& here***" + f" {k}" for k in range(8))
    licence = clean + "\nLicensed under CC BY 4.0."
    docs = make([clean, menu, noise, licence, None, "", "too short."])
    kept = {r.doc_id: r for r in quality.clean_documents(docs).collect()}
    assert set(kept) == {0, 3} and kept[0].text == clean and kept[3].text == clean and kept[3].n_chars == len(clean)
    assert quality.clean_documents(docs).columns == docs.columns


def test_repeated_windows_by_brute_force(spark, make):
    import random

    random.seed(2)
    texts = [" ".join(random.choice("abc") for _ in range(n)) for n in (5, 8, 9, 40, 60, 200)] + ["same words here again " * 12]
    docs = make(texts)
    got = docs.select("doc_id", quality.quality_of(docs.text).alias("q")).collect()
    for r in got:
        w = texts[r.doc_id].split()
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        assert r.q.n_repeat_words == len(covered) and r.q.n_words == len(w)


def test_quality_and_lines_on_awkward_rows(make, awkward):
    docs = make(awkward)
    assert docs.select(quality.quality_of(docs.text).alias("q")).count() == len(awkward)
    assert quality.clean_documents(docs.limit(0)).count() == line_dedup.clean_documents(docs.limit(0)).count() == 0
    assert line_dedup.clean_documents(docs).columns == docs.columns


def test_line_dedup_is_relative_to_the_site(make):
    rows = [(f"unique {k}\nfooter line\nbody {k}", "en", "big") for k in range(20)] + [("footer line\nother", "en", "small")]
    out = {r.doc_id: r.text for r in line_dedup.clean_documents(make(rows)).collect()}
    assert out[3] == "unique 3\nbody 3" and out[20] == "footer line\nother"


def test_line_dedup_drops_texts_without_words(make):
    rows = [("footer line", "en", "big")] * 20 + [("footer line\nbody", "en", "big"), (None, "en", "big")]
    out = {r.doc_id: r.text for r in line_dedup.clean_documents(make(rows)).collect()}
    assert out == {20: "body", 21: None}


def test_cut_copies_are_beginnings_of_their_texts(make):
    texts = [f"\n one{k}\n\n  two \t three{k}\n" + "more  words\n" * k for k in range(12)]
    out = mixing.mixed_documents(make([(t, "en", f"s{k % 3}") for k, t in enumerate(texts)])).collect()
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in out)
    assert any(texts[r.doc_id] != r.text for r in out)


def test_line_dedup_leaves_copies_to_near_dedup(make):
    copied = "first line\nsecond line"
    rows = [(copied, "en", "big")] * 20 + [(copied + "\nthird", "en", "big")] + [(f"unique {k}", "en", "big") for k in range(30)] + [("small line", "en", "small")] * 3
    out = {r.doc_id: r.text for r in line_dedup.clean_documents(make(rows)).collect()}
    assert out == {k: text for k, (text, *_) in enumerate(rows)}


def test_pipeline_stages_keep_columns(spark, make, awkward, sf_dir):
    docs = make(awkward)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        nothing = stage(spark, docs.limit(0), sf_dir)
        out = stage(spark, docs, sf_dir)
        assert nothing.count() == 0 and out.count() >= 0
        if k < 4:
            assert out.columns == docs.columns


def test_pipeline_runs(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.exact and r.n_tokens == len(r.ids) for r in rows)


def test_slices_of_hot_hosts_change_nothing(make, monkeypatch):
    rows = [(f"menu\nfooter\nbody {k}\n", "en", "hot" if k % 3 else f"h{k}") for k in range(60)] + [(None, "en", "hot"), ("menu", None, None)]
    whole = sorted(map(str, line_dedup.clean_documents(make(rows)).collect()))
    for slices in (3, 10_000):
        monkeypatch.setattr(line_dedup, "SLICES", slices)
        assert sorted(map(str, line_dedup.clean_documents(make(rows)).collect())) == whole


def test_pages_on_awkward_rows(spark, tmp_path):
    import duckdb
    from oracle import same

    html = "<html><head><title>t</title></head><body><nav>menu</nav><p>text {}</p></body></html>"
    rows = [(k, f"https://a.org/{k}", html.format(k)) for k in range(5)] + [(5, "https://a.org/5", None), (6, None, html.format(6)), (7, "https://b.org", ""), (None, "nohost", "<p>x</p>"), (1, "https://a.org/1", html.format(1))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(line_dedup.op7_line_dedup(spark, str(tmp_path)), con, line_dedup.ORACLE)


def test_plan_is_the_truncated_queue(make):
    """Where no source is capped, targets by source are what the queue in order of finish serves up to the budget."""
    rng = random.Random(6)
    rows = [(" ".join(["w"] * rng.randint(1, 30)), "en", f"s{k % 3}") for k in range(300)]
    plan = mixing.mixing_plan(make(rows), budget_ratio=0.6).collect()
    weight = {r.source: r.weight for r in plan}
    queue = []
    for s in weight:
        clock = 0
        for r in sorted((r for r in plan if r.source == s), key=lambda r: r.begin):
            clock += r.size
            queue.append((clock / weight[s], s, r.size))
    budget, served = 0.6 * sum(r.size for r in plan), dict.fromkeys(weight, 0)
    for _, s, size in sorted(queue):
        if sum(served.values()) + size > budget:
            break
        served[s] += size
    for s in weight:
        taken = sum(r.taken for r in plan if r.source == s)
        assert abs(taken - served[s]) <= 60 and taken == int(next(r.target for r in plan if r.source == s))
