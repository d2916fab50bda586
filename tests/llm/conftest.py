import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"
NASTY = [
    (3, "The quick brown fox jumps over the lazy dog. The quick brown fox again!", "en", "b", 1, 0.5, 9),
    (1, None, "en", "a", 0, None, None),
    (2, "", None, None, 0, 0.1, 1),
    (5, "the QUICK brown fox jumps over the lazy dog. the quick brown fox again!", "en", "b", 1, 0.5, 9),
    (4, "  two  spaces\n\nand\tlines \n and <|endoftext|> special é ü 漢字 😀 ", "de", "c", 9, 0.2, 2),
    (7, "word", "en", "a", 4, 0.3, 3),
    (7, "word", "en", "a", 4, 0.3, 3),
    (None, "a document without a number", "fr", "b", 2, None, 4),
    (9, "x" * 30_000, "en", "c", 30_000, 0.0, 5),
    (8, " ".join(f"w{i % 977}" for i in range(6_000)), "en", "c", 1, 0.0, 6),
    (10, "idiot $$$ moron&&& stupid", "en", "b", 1, 0.0, 7),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty, long and repeated texts, and columns whose names clash with those of the operators."""
    return spark.createDataFrame(NASTY, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
