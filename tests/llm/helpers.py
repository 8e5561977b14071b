"""Small tables with every awkward case, and a plain word splitter."""

import re

WORD = re.compile(r"\w+")
LONG = "word " * 30_000


def words(text):
    return WORD.findall((text or "").lower())


def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeats and a clashing extra column."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x"), (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x"),
        (2, "The quick, brown fox jumps over the lazy dog!", None, None, None, None), (3, "", "en", "a", 0, ""), (4, None, None, "b", None, "y"), (None, "a text without an id number here", "en", None, 3, "z"),
        (None, None, None, None, None, None), (5, LONG, "en", "c", 4, "score"), (6, "!!! ... ???", "en", "c", 4, "s"), (7, "x" * 5000, "de", "c", 4, "s"), (8, " \t\n ", "de", "c", 4, "s"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
