import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, `size` long, `key` string, _text string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (text, lang, source), with further columns whose names operators use inside."""

    def documents(rows, ids=None):
        out = []
        for k, r in enumerate(rows):
            text, lang, source = r if isinstance(r, tuple) else (r, "en", f"s{k % 3}")
            out.append((k if ids is None else ids[k], text, lang, source, None if text is None else len(text), "r", 1, "k", "t"))
        return spark.createDataFrame(out, SCHEMA)

    return documents


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, a long text."""
    sentence = "The quick brown fox jumps over the lazy dog near the quiet river bank today. "
    return [None, "", " \n\t ", "x", sentence * 4, sentence * 4, "word " * 30000, "Ünïcödé façade naïve 日本語 " * 20, ("null source text " * 10, None, None), ("a\n\nb\nb\n", "de", "s1")]
