import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, taken string, score string, raw string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with results."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "b", 10, "x", "x", "x", "x"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", None, "x", None, "x", "x"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", None, "x", None, "x", "x"),
        (3, "", None, "a", 0, None, None, None, None),
        (4, None, None, None, None, None, None, None, None),
        (None, "", "en", "c", 0, None, None, None, None),
        (None, "one two", "en", None, 7, None, None, None, None),
        (5, long, "en", "b", len(long), None, None, None, None),
        (6, "   \n\t ", "en", "b", 6, None, None, None, None),
        (7, "password=hunter22 and key sk1Zx9Qp4Lm8Rt2Vb7Nc5", "en", "b", 6, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
