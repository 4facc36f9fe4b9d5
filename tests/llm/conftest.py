import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 1),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 2),
        (4, " \t\n ", "en", "a", 4, "x", 3),
        (None, "a text without an id", "en", "b", 20, "y", 4),
        (5, LONG, "en", "a", len(LONG), "x", 5),
        (6, "éÉß İ Σσς <|endoftext|> 12% 😀 | naïve", "fr", "c", 36, "z", 6),
        (7, "word", "en", "a", 4, "x", 7),
        (8, "the QUICK brown fox jumps over the lazy dog", "en", "a", 43, "x", 8),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, block int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
