"""URL filters, importance resampling and conversation repair against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from larkspur.llm import conversations, importance, url_rules

URLS = [
    None,
    "",
    "no scheme/en/1",
    "http://a.example.net/en/1",
    "http://EXAMPLE.net/en/",
    "http://example.network/en/1",
    "http://notexample.net/en/1?x=1",
    "https://de.example.com/de/x#top",
    "https://example.com/DE/x",
    "https://a.b.org/fr/1",
    "https://org/fr/",
    "http://x.net",
    "http://x.net?page=2",
    "http://www.cheap-pills.example.com/en/1",
    "http://not-cheap-pills.example.com/en/1",
    "http://site.example.com/wp-login.php?next=/",
    "http://site.example.com/a?PHPSESSID=12",
    "http://docs.example.com/login",
    "http://example.com/calendar/2020/01/print",
    "ftp://example.com/file",
    "http://example.com/file.zip",
    "http://example.com/file.zip?x",
    "http://u@[v]+(w).example.com/a\nb/login",
    "http://example.com/" + "a/" * 50000 + "poker/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, "h", "r", 1, "t", 2) for k, u in enumerate([*URLS, *URLS[3:6]])]
    return spark.createDataFrame(rows, "page_id long, url string, html string, `row` string, low int, `token` string, fits int")


def plain_verdict(url, patterns):
    u = url if url and "://" in url else ""
    rest = u[u.index("://") + 3 :] if u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, low = host.translate({c: c + 32 for c in range(65, 91)}), u.translate({c: c + 32 for c in range(65, 91)})
    sites = [(len(h + p), h + p, v) for v, h, p in url_rules.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hits = [(v == "allow", len(p), p, v) for v, p in patterns if re.search(url_rules.regex_of(p).replace("$", r"\Z"), low)]
    if not u:
        hits = [h for h in hits if re.search(url_rules.regex_of(h[2]).replace("$", r"\Z"), "")]
    verdict = max(sites)[2] if sites else max(hits)[3] if hits else "allow"
    return host, path, max(sites)[1] if sites else None, verdict, None if sites or not hits else max(hits)[2], len(sites) + len(hits)


@pytest.mark.parametrize("further", [(), (("block", "*"), ("block", "example"), ("allow", "wp-*.php"), ("block", "||de.|"), ("block", "|http://x.net|"), ("block", "pil*s."))])
def test_verdicts_equal_those_of_all_rules(spark, pages, further):
    patterns = url_rules.PATTERN_RULES + further
    got = url_rules.judged(pages, url_rules.site_rules(spark), url_rules.pattern_rules(spark, patterns)).collect()
    want = Counter((k % len(URLS) if k < len(URLS) else k, *plain_verdict(u, patterns)) for k, u in enumerate([*URLS, *URLS[3:6]]))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern, r.n_matched) for r in got) == want
    assert all(r.n_candidates >= r.n_matched for r in got)
    if not further:
        assert sum(r.n_candidates for r in got) < len(got) * 4  # of 40 rules


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://site.com/cgi-bin/x",)] * 3 + [("http://site.com/cgi/x",)], "low string")
    rules = url_rules.compiled(url_rules.site_rules(spark, [("block", "site.com", "/")]), url_rules.pattern_rules(spark, [("block", "/cgi-bin/"), ("block", "a*b")]))
    assert {r.rule: r.token for r in url_rules.indexed(rules, urls).collect()} == {"site.com/": "com", "/cgi-bin/": "bin", "a*b": ""}


def test_allowed_pages_and_empty_tables(spark, pages):
    sites, patterns = url_rules.site_rules(spark), url_rules.pattern_rules(spark)
    kept = url_rules.allowed_pages(pages, sites, patterns)
    assert kept.columns == pages.columns
    want = [k for k, u in enumerate([*URLS, *URLS[3:6]]) if plain_verdict(u, url_rules.PATTERN_RULES)[3] == "allow"]
    assert sorted(r.page_id for r in kept.collect()) == want
    assert url_rules.judged(pages.limit(0), sites, patterns).count() == 0
    none = url_rules.judged(pages, sites.limit(0), patterns.limit(0)).collect()
    assert len(none) == len(URLS) + 3 and {(r.verdict, r.rule) for r in none} == {("allow", None)}


def plain_scores(docs, target):
    def features(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    parsed = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in parsed for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in parsed:
        weight = sum(math.floor(1000 * math.log(((t[b] + 1.0) * (S + 10000.0)) / ((s[b] + 1.0) * (T + 10000.0)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    k = 5 * sum(x[4] >= 20 for x in out) // 100
    order = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0]))[:k]
    return out, order


def test_importance_by_brute_force(spark, make, awkward):
    random.seed(5)
    words = ["Ärger", "straße", "River", "hill", "x1", "the", "of", "日本", "İ", "a-b"]
    texts = [" ".join(random.choices(words, k=random.choice((0, 3, 19, 20, 25, 40)))) for _ in range(120)] + [t if not isinstance(t, tuple) else t[0] for t in awkward] + ["same text here " * 9] * 3
    ids = [None if k == 7 else k if k < len(texts) - 3 else 1000 for k in range(len(texts))]
    target = [None, "", "river hill the", "The River of x1 straße"]
    docs, aims = make(texts, ids), make(target)
    got = importance.drawn(importance.scored(docs, aims)).collect()
    want, order = plain_scores(list(zip(ids, texts, strict=True)), target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in ranked] == [(x[0], x[3]) for x in order] and [r["rank"] for r in ranked] == list(range(1, len(order) + 1))
    sample = importance.resampled(docs, aims, percent=50)
    assert sample.columns == docs.columns and sample.count() == 50 * sum(x[4] >= 20 for x in want) // 100 > 30
    for empty in (importance.drawn(importance.scored(docs.limit(0), aims)), importance.resampled(docs.limit(0), aims.limit(0))):
        assert empty.count() == 0
    assert importance.scored(docs, aims.limit(0)).count() == len(texts)


def plain_order(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    return {c: sorted(v, key=lambda y: (y[1] is not None, y[1] or 0, y[2], y[3])) for c, v in by.items()}


def plain_faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "-" if last[0] in ".!?" else "t")
        seen.add((role, text))
    return out


def all_repairs(rows, faults):
    """Every way with up to two inserts between rows, least (cost, audit) first."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(k, cost, audit, lines):
        nonlocal best
        for ins in inserts:
            c, a, out = cost + 3 * len(ins), audit + "I" * len(ins), [*lines, *((r, "") for r in ins)]
            if best and c > best[0]:
                continue
            if k == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
                continue
            _, _, role, text = rows[k]
            go(k + 1, c + 4, a + "D", out)
            if faults[k] not in "bd":
                extra = 3 * (faults[k] == "t")
                go(k + 1, c + extra, a + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(k + 1, c + 3 + extra, a + "R", [*out, (r, text)])

    go(0, 0, "", [])
    return best


@pytest.fixture(params=[(10, 6), (1, 1)], ids=["chunks of 1024", "chunks of 2, binary tree"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", request.param[0])
    monkeypatch.setattr(conversations, "FAN_BITS", request.param[1])


def test_repair_by_all_ways(spark, sizes):
    random.seed(11)
    rows = []
    for c in range(30):
        for t in range(random.choice((0, 1, 2, 3, 4))):
            rows.append((None if c == 4 else c, random.choice((t, t, None, 7)), random.choice(("user", "assistant", "system", "user", "assistant", "tool", None, "")), random.choice(("Yes.", "No", "", None, "Well!", " \t", "So? \n"))))
    rows += [rows[0]] * 2
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, chunk int, pos string")
    plain = frame.select("conv_id", "turn", "role", "text")
    got = {r.conv_id: r for r in conversations.report(plain, plain).collect()}
    fixed = {}
    for r in conversations.repaired_rows(plain).orderBy("pos", "place").collect():
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    grouped = plain_order(rows)
    assert set(got) == set(grouped)
    for c, turns in grouped.items():
        faults = plain_faults(turns)
        cost, audit, out = all_repairs(turns, faults)
        numbers = {t for _, t, _, _ in turns if t is not None}
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert fixed.get(c, []) == out
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(x) for x in "bdt"]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert r.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))


def test_long_conversation_over_partitions(spark, sizes):
    random.seed(3)
    rows = [(1, t, random.choice(("user", "assistant", "system")), random.choice(("a.", f"n {t}.", f"m {t}", ""))) for t in range(700)] + [(2, 0, "user", "w " * 200000 + ".")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in conversations.report(frame, frame).collect()}
    turns = plain_order(rows)[1]
    ways = {0: (0, "")}
    for (_, _, role, _), fault in zip(turns, plain_faults(turns), strict=True):
        ways = conversations.advance(ways, conversations.MATRICES[role[0], fault])
    cost, audit, last = conversations.completed(ways)
    assert (got[1].cost, got[1].audit) == (cost, audit + conversations.COMPLETE[last])
    assert (got[2].cost, got[2].audit) == (3, "KI")


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t and t % 2 else None, f"Text {t}! Really?") for c in (1, None) for t in (*range(40), None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in conversations.damaged(frame).collect())
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fate == 4 else " " if role is None else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want[c, t, role, text] += {0: 0, 3: 2}.get(fate, 1)
    assert got == +want
    empty = frame.limit(0)
    assert conversations.report(empty, empty).count() == conversations.repaired_rows(empty).count() == 0
    gone = conversations.report(frame, empty).collect()
    assert [(r.gaps, r.cost, r.audit, r.repaired_sha256) for r in gone] == [(0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_verdict_of_a_hot_value_equals_that_of_others(spark, make, monkeypatch):
    from larkspur.llm import secrets

    texts = [(f"note {k}\npassword = example1234", "en", f"s{k % 5}") for k in range(30)] + [(f"token: own{k % 3}value99 ghp_{'a' * 20}{k}", "en", "s1") for k in range(9)]
    results = []
    for hot in (1000, 1):  # every value hot, none hot
        monkeypatch.setattr(secrets, "HOT", hot)
        results.append(sorted(map(tuple, secrets.secret_spans(make(texts)).collect())))
    assert results[0] == results[1]
    assert sum(r[7] for r in results[0]) == 30 and sum(r[6] for r in results[0]) == 18


def test_language_batches_hold_few_letters(spark, make, monkeypatch):
    from larkspur.llm import language

    texts = [("the cat sat on the mat and the dog ran " * 5, "en", "a"), ("der hund lief und die katze sass auf der matte " * 5, "de", "a")] * 3
    docs = make([*texts, ("the dog and the cat " * 400, None, None), ("die katze und der hund " * 400, None, None), (None, None, None)])
    samples = language.learn(docs)
    assert dict(samples).keys() == {"de", "en"} and all(len(v) == 1 for _, v in samples)
    whole = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, samples).collect())
    assert [w[1] for w in whole] == ["en", "de"] * 3 + ["en", "de", "und"]
    pieces = language.slices([100, 10, 5, 300, 1], 120)
    assert pieces == [(0, 3), (3, 4), (4, 5)] and language.slices([], 5) == []
