import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __text string, rep long, h long, copies int, rate string, `a.b` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank, repeated and very long texts, ties, clashing column names."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta.", "en", "a"), (2, "Alpha beta gamma delta.", "en", "a"), (2, "Alpha beta gamma delta.", "en", "a"),
        (3, "", "en", "b"), (4, "   \n\t", "en", None), (5, None, "fr", "b"), (6, "x", None, "b"), (7, "123 456 !!", "en", "c"),
        (8, long, "en", "c"), (9, long + " tail", "en", "c"), (10, "Ünïcode été Straße über", "fr", "a"), (None, "nobody owns this text", "en", "a"), (11, "x", "en", None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "t", 1, 2, 3, "r", "dot") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
