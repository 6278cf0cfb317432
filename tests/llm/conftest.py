import pytest

from fraylens.llm.shared import ship


@pytest.fixture(scope="session")
def spark(spark):
    ship(spark)
    return spark


DOCS = "doc_id long, text string, lang string, score double, kept boolean, digest string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = "the walls of thornwood are very old and the moss on it is deep " * 800
    rows = [(1, "The quick brown fox jumps over the lazy dog and runs to the river", "en", 0.5, True, "d", 64),
            (2, "The quick brown fox jumps over the lazy dog and runs to the river", "en", 0.5, True, "d", 64),
            (3, "", None, None, None, None, 0), (4, None, None, None, None, None, None), (5, " \n\t ", "en", None, False, "", 4),
            (6, long, "en", 1.0, True, "x", len(long)), (6, long, "en", 1.0, True, "x", len(long)), (None, "a row without id is here", "en", 0.1, True, "y", None),
            (2 ** 60 + 1, "Ein großer Fluß, naïve café <|endoftext|> 😀 ﬁn'll isn't 12³ ½", "de", 0.1, True, "z", 9), (8, "x" * 30000, "en", 0.2, True, "w", 30000)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
