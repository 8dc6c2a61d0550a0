import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Cases that every operator must take: null, empty, blank and very long texts, ties, repeated rows, a null id.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "The cat sat on the mat and the dog sat on the rug.\nAll was well in the house that day.", "en", "a", None),
    (4, "The cat sat on the mat and the dog sat on the rug.\nAll was well in the house that day.", "en", "a", None),
    (5, "THE CAT SAT ON THE MAT and the dog sat on the rug.\nAll was well in the house that day.", "en", None, 1),
    (6, "der Hund und die Katze 日本語 \U0001f642 é é ﬁ", "de", "b", 1),
    (7, "word " * 30000, "en", "b", 1),
    (8, "x" * 50000, None, "b", 1),
    (None, "no id here but some words all the same", "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make_text():
    def make(rng: random.Random, n: int, words: int = 400) -> str:
        return " ".join(f"w{rng.randrange(words)}" for _ in range(n))

    return make
