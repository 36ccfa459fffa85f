"""Cues in whole texts by tables of rules of any length, and the profiles that they give.

One automaton holds all stems of a part of the rules, so a text is read once a part, however many rules there are.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cue_text(c: Column) -> Column:
    """Lower case, ё as е, all but Latin and Cyrillic letters and digits as one blank, with a blank at both ends."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), "[^а-яa-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def cue_pattern(stem: Column, short: int = 3) -> Column:
    """What a stem looks for in a cue text: a phrase anywhere, up to `short` characters a whole word, else the start of a word."""
    return F.when(F.contains(stem, F.lit(" ")), stem).when(F.length(stem) <= short, F.concat(F.lit(" "), stem, F.lit(" "))).otherwise(F.concat(F.lit(" "), stem))


def cue_hits(texts: DataFrame, stems: DataFrame, *, part: int = 50_000) -> DataFrame:
    """(id, stem, n): how often each distinct stem of (stem) stands in the text of (id, text), for those that do.

    Stems are dealt into parts of about `part` rows by hash; the driver holds the stems of one part at a time and each
    task an automaton of them, and texts are read once a part. Overlapping hits all count. A null or empty stem
    never hits; a null text has no hits. ids are unique.
    """
    known = stems.where("stem <> ''").select("stem").distinct().withColumn("pattern", cue_pattern(F.col("stem")))
    parts = max(1, -(-known.count() // part))
    kind = texts.schema["id"].dataType.simpleString()
    read = texts.where("text IS NOT NULL").select("id", cue_text(F.col("text")).alias("text"))
    found = None
    for p in range(parts):
        held = [tuple(r) for r in known.where(F.pmod(F.xxhash64("stem"), F.lit(parts)) == p).collect()]
        hits = read.mapInArrow(_scanner(held), f"id {kind}, stem string, n long")
        found = hits if found is None else found.unionByName(hits)
    return found


def _scanner(held: list[tuple[str, str]]):
    def scan(batches):
        machine = ahocorasick.Automaton()
        stems = {}
        for stem, pattern in held:
            stems.setdefault(pattern, []).append(stem)
        for pattern in stems:
            machine.add_word(pattern, pattern)
        if stems:
            machine.make_automaton()
        for batch in batches:
            at, stem, n = [], [], []
            for row, text in enumerate(batch.column(1)) if stems else ():
                counts = {}
                for _, pattern in machine.iter(text.as_py()):
                    counts[pattern] = counts.get(pattern, 0) + 1
                for pattern, count in counts.items():
                    for s in stems[pattern]:
                        at.append(row)
                        stem.append(s)
                        n.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(stem, pa.string()), pa.array(n, pa.int64())], ["id", "stem", "n"])

    return scan


def cue_axes(items: DataFrame, cues: DataFrame, priors: DataFrame, defaults: dict[str, float], *, part: int = 50_000) -> DataFrame:
    """Items with a column an axis: mean value of the cues whose stem stands in the text, else mean of the priors of its kinds, else the default.

    items: id, text, kinds (array), other columns; cues: axis, stem, value; priors: kind, axis, value. A stem
    counts once a text. A rule given twice counts twice.
    """
    axes = list(defaults)
    mean = lambda df: df.groupBy("id").pivot("axis", axes).agg(F.avg("value"))
    hits = cue_hits(items.select("id", "text"), cues.select("stem"), part=part)
    told = mean(hits.join(cues.select("axis", "stem", "value"), "stem"))
    known = mean(items.select("id", F.explode(F.array_distinct("kinds")).alias("kind")).join(priors, "kind"))
    named = lambda df, end: df.select("id", *[F.col(a).alias(f"{a}{end}") for a in axes])
    joined = items.join(named(told, "_told"), "id", "left").join(named(known, "_known"), "id", "left")
    return joined.withColumns({a: F.coalesce(f"{a}_told", f"{a}_known", F.lit(v)) for a, v in defaults.items()}).drop(*[f"{a}{end}" for a in axes for end in ("_told", "_known")])


def half_steps(c: Column) -> Column:
    """To the nearest half, halves of a half to even."""
    return (F.bround(c * 2) / 2).cast("double")


def occasions(*, sweetness: Column, body: Column, oak: Column, sparkling: Column) -> Column:
    """What a profile suits, in a fixed order; `everyday` if nothing else fits. Axes are taken before rounding."""
    fits = F.array(
        F.when(sparkling, "celebration"),
        F.when(sparkling, "aperitif"),
        F.when(sweetness >= 3.5, "dessert"),
        F.when(body >= 3.5, "dinner"),
        F.when((body <= 2.5) & (sweetness <= 2) & ~sparkling, "picnic"),
        F.when((oak >= 3.5) & (body >= 4), "special"),
    )
    found = F.filter(fits, lambda o: o.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("everyday")))
