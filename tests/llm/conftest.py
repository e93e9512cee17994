from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, id string, n string"


@pytest.fixture(scope="session")
def edge(spark):
    """NULLs, empty, long, repeated and equal texts, and clashing column names."""
    word = " ".join(f"word{i}" for i in range(200))
    near = word.replace("word100", "other")
    rows = [
        (0, None, "en", "a"), (1, "", None, None), (2, " \n\t ", "en", "a"), (3, word, "en", "a"),
        (4, word, "de", "b"), (5, near, "en", "b"), (6, "one two", "en", "a"), (7, "ONE  two", "en", "b"),
        (8, "a b c d " * 5000, "en", "a"), (9, "password = 'abcdefghijkl' x", "en", "a"),
        (9, "password = 'abcdefghijkl' x", "en", "a"), (None, word, "en", "a"),
        (11, "é漢字 😀 <|endoftext|> 12", None, "c"), (12, "l1 l1\nl1 l1\nl2 \n", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "k", "s", "i", "n") for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
