import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Small documents with the cases that every operator must define.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the dog", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the dog", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the dog", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\r\n\x0b\x0c ", None, "b", 0),
    (6, "word", "en", None, 4),
    (7, "Two Words", "en", "a", 9),
    (8, "two words", "en", "a", 9),
    (9, "one word \U0001f600 café naïve Kelvin <|endoftext|>  double  \n \n blank ", "fr", "c", 9),
    (None, "no id here at all, only words and more words", "en", "a", 9),
    (10, "long " * 40000 + "end", "en", "c", 1),
]


@pytest.fixture()
def odd(spark):
    """The odd documents with further columns whose names clash with outputs."""
    rows = [(*r, "x", 1.5, 7, True, "k") for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", lang_pred string, score double, size long, kept boolean, key string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
