"""Normal forms of text that need Unicode tables, and letter-by-letter rewriting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Cyrillic letters and their Latin spelling.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Words of labels and catalogues in one spelling (module form "folded").
FOLDED_WORDS = {
    "cabernet": "kaberne", "sauvignon": "sovinon", "pinot": "pino", "noir": "nuar", "chardonnay": "shardone", "merlot": "merlo",
    "riesling": "risling", "syrah": "sira", "shiraz": "sira", "muscat": "muskat", "brut": "bryut", "reserve": "rezerv",
    "blanc": "blan", "franc": "fran", "chateau": "shato", "massandra": "massandra",
}
# Phrases of shops in the catalogue's spelling (form "translated"), longer ones of a word first.
TRANSLATED_PHRASES = {
    "cabernet sauvignon": "каберне совиньон", "cabernet franc": "каберне фран", "sauvignon blanc": "совиньон блан", "pinot noir": "пино нуар",
    "pinot blanc": "пино блан", "pinot gris": "пино гри", "chardonnay": "шардоне", "riesling": "рислинг", "merlot": "мерло", "saperavi": "саперави",
    "aligote": "алиготе", "syrah": "сира", "viognier": "вионье", "brut": "брют", "rose": "розе", "reserve": "резерв", "fanagoria": "фанагория",
    "massandra": "массандра", "myskhako": "мысхако", "aristov": "аристов", "chateau tamagne": "шато тамань", "abrau durso": "абрау дюрсо",
    "alma valley": "альма велли", "chateau pinot": "шато пино", "chateau de talu": "шато де талю", "miroir de talu": "мируар де талю",
    "krasnostop": "красностоп", "shiraz": "шираз", "muscat": "мускат", "clairet": "клере", "rouge": "руж", "blanc": "блан",
    "oenologist": "энолог", "reflexion": "рефлексион", "uroki frantsuzskogo": "уроки французского",
}
# Prefixes of resized copies of an upload.
SIZE_PREFIXES = ("thumbnail_", "small_", "medium_", "large_")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Decomposed, combining marks dropped, lower case."""
    plain = texts.str.normalize("NFKD").str.replace(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+", "", regex=True)
    return plain.str.lower()


def transliterate(text: Column) -> Column:
    """Lower case with each Cyrillic letter in its Latin spelling."""
    out = F.lower(text)
    for letter, latin in LATIN.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in LATIN.items() if len(v) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def replaced_words(text: Column, words: dict[str, str]) -> Column:
    """Whole words of the text replaced, in the order given."""
    for old, new in words.items():
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return text


def replaced_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced wherever they stand, in the order given."""
    for old, new in phrases.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def spaced(text: Column, letters: str = "а-яa-z0-9 ") -> Column:
    """Lower case with everything but the letters and blanks dropped one by one to blanks, neither collapsed nor trimmed."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), f"[^{letters}]+", " ")


def word_form(text: Column) -> Column:
    """Compatibility form with everything but letters, digits and _ of any script as single blanks."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"(?U)[^\w]+", " "))


def translated(text: Column, phrases: dict[str, str], letters: str = "a-zа-я0-9") -> Column:
    """Compatibility form with phrases in one spelling."""
    return F.trim(F.regexp_replace(replaced_phrases(F.replace(F.lower(nfkc(text)), F.lit("ё"), F.lit("е")), phrases), f"[^{letters}]+", " "))


def folded(text: Column, words: dict[str, str]) -> Column:
    """Plain Latin: marks dropped, letters transliterated, words in one spelling, only a-z and 0-9."""
    return F.trim(F.regexp_replace(replaced_words(transliterate(without_marks(text)), words), "[^a-z0-9]+", " "))


def ocr_form(text: Column, letters: str = "а-яa-z0-9.") -> Column:
    """Recognised text: decimal commas are dots, dots stay."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), F.lit(","), F.lit(".")), f"[^{letters}]+", " "))


def file_base(name: Column) -> Column:
    """Name of an upload without size prefix, 10-digit hash and image suffix."""
    bare = F.regexp_replace(name, "^(?:" + "|".join(SIZE_PREFIXES) + ")", "")
    return F.regexp_replace(bare, r"(?i)_[0-9a-f]{10}\.(?:webp|jpg|jpeg|png)$", "")


def file_key(name: Column) -> Column:
    """Comparable form of a file name: transliterated, everything else as single _, lower case."""
    stem = F.regexp_replace(name, r"(?i)\.(?:webp|jpg|jpeg|png)$", "")
    return F.btrim(F.regexp_replace(transliterate(stem), "[^a-z0-9]+", "_"), F.lit("_"))


def name_tokens(text: Column, stop: list[str]) -> Column:
    """Distinct tokens of a product name without volumes, years, stop words and single letters."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\b\d+(?:[.,]\d+)?\s*(?:ml|l|litre|мл|л)\b", " "), r"\b(?:19|20)\d{2}\b", " ")
    return F.array_distinct(F.filter(F.split(collapsed(bare), " "), lambda t: (t != "") & ~t.isin(stop) & ((F.length(t) > 1) | t.rlike(r"^\d$"))))


def years_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), 1))


def visible_years(lines: Column, least: float = 0.5) -> Column:
    """Years of vintage among recognised lines (text, confidence): a year alone or beside a word for vintage, no founding dates."""
    bare = lambda x: F.btrim(x["text"], F.lit(" -.,:;()[]"))
    fit = F.filter(lines, lambda x: (x["confidence"] >= least) & ~bare(x).rlike(r"(?i)(since|est\.?|founded)") & (bare(x).rlike(r"^(?:19[89]\d|20[012]\d)$") | bare(x).rlike(r"(?i)vintage\s*(?:19|20)\d{2}")))
    return F.array_distinct(F.flatten(F.transform(fit, lambda x: F.regexp_extract_all(x["text"], F.lit(r"((?:19|20)\d{2})"), 1))))


def parsed_slug(slug: Column, colors: list[str], sweetness: list[str]) -> Column:
    """(year, color, sweetness, strength) of a dashed slug.

    The last colour counts; after it come sweetness words and numbers of up to three digits, and sweetness
    words may stand in the two places before it.
    """
    tokens = F.split(slug, "-")
    year = F.get(F.filter(tokens, lambda t: t.rlike(r"^(?:19|20)\d{2}$")), F.lit(0))
    at = F.array_max(F.transform(tokens, lambda t, i: F.when(t.isin(colors), i)))
    after = F.slice(tokens, at + 2, F.greatest(F.size(tokens) - at - 1, F.lit(0)))
    before = F.slice(tokens, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))
    behind = F.filter(after, lambda t: t.isin(sweetness))
    words = F.concat(behind, F.array_except(F.filter(before, lambda t: t.isin(sweetness)), behind))
    strength = F.filter(after, lambda t: t.rlike(r"^\d{1,3}$"))
    empty = F.array().cast("array<string>")
    return F.struct(year.alias("year"), F.get(tokens, at).alias("color"), F.coalesce(words, empty).alias("sweetness"), F.coalesce(strength, empty).alias("strength"))


def largest_source(srcset: Column) -> Column:
    """The candidate of a srcset with the largest width or density; a candidate without one counts as 1."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.split(F.btrim(p), r"\s+")), lambda p: p[0] != "")
    size = lambda p: F.when(F.size(p) > 1, F.coalesce(F.nullif(F.regexp_replace(F.element_at(p, -1), "[^0-9.]", ""), F.lit("")).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
    return F.array_max(F.transform(parts, lambda p: F.struct(size(p).alias("size"), p[0].alias("url"))))["url"]


def collapsed(text: Column, letters: str = "а-яa-z0-9") -> Column:
    """Lower case, everything but the letters as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), f"[^{letters}]+", " "))


def stem(word: Column, length: int = 5) -> Column:
    return F.left(word, F.lit(length))


def first_number(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
