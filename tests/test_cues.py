"""Cue automaton against a plain search for every stem."""

from pyspark.sql import functions as F

from larkspur.operators import cues

STEMS = ["oak", "oaken", "van", "vanil", "bright acid", "ß", "сух", "сухо", "a", "", None, "oak"]
TEXTS = [(1, "Oak, oaken VANILLA; bright  acidity"), (2, "soaked oaks van"), (3, None), (4, ""), (5, "Сухое сух вино ё"), (6, "a b a aa " * 500), (7, "bright-acid bright acid")]


def plain(text, stem):
    import re

    norm = " " + re.sub("[^а-яa-z0-9]+", " ", text.lower().replace("ё", "е")).strip() + " "
    pattern = stem if " " in stem else f" {stem} " if len(stem) <= 3 else f" {stem}"
    return sum(norm.startswith(pattern, i) for i in range(len(norm)))


def expected():
    return {(i, s, plain(t, s)) for i, t in TEXTS if t is not None for s in set(STEMS) if s and plain(t, s)}


def test_hits_in_any_number_of_parts(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    stems = spark.createDataFrame([(s,) for s in STEMS], "stem string")
    for part in (50_000, 3):
        got = cues.cue_hits(texts, stems, part=part).collect()
        assert {(r.id, r.stem, r.n) for r in got} == expected()
        assert len(got) == len(expected())


def test_no_rules_and_no_texts(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    none = spark.createDataFrame([], "stem string")
    assert cues.cue_hits(texts, none).collect() == []
    assert cues.cue_hits(texts.where("id < 0"), spark.createDataFrame([("oak",)], "stem string")).collect() == []


def test_cues_then_priors_then_defaults(spark):
    items = spark.createDataFrame([(1, "oaken and full", ["x"]), (2, "nothing", ["x", "y"]), (3, None, None)], "id long, text string, kinds array<string>")
    rules = spark.createDataFrame([("body", "full", 4.0), ("body", "oaken", 5.0), ("oak", "oaken", 3.0)], "axis string, stem string, value double")
    priors = spark.createDataFrame([("x", "body", 1.0), ("y", "body", 2.0)], "kind string, axis string, value double")
    got = {r.id: (r.body, r.oak) for r in cues.cue_axes(items, rules, priors, {"body": 2.5, "oak": 1.5}).collect()}
    assert got == {1: (4.5, 3.0), 2: (1.5, 1.5), 3: (2.5, 1.5)}


def test_half_steps_and_occasions(spark):
    rows = spark.createDataFrame([(1.25, 2.0, False), (1.75, 4.0, True), (3.0, 3.0, False)], "s double, b double, f boolean")
    got = rows.select(cues.half_steps(F.col("s")).alias("h"), cues.occasions(sweetness=F.col("s"), body=F.col("b"), oak=F.lit(4.0), sparkling=F.col("f")).alias("o")).collect()
    assert [(r.h, r.o) for r in got] == [(1.0, ["picnic"]), (2.0, ["celebration", "aperitif", "dinner", "special"]), (3.0, ["everyday"])]
