import pytest

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ho", "ki", "lo") for b in ("ma", "ne", "pi", "ro", "su", "ta", "ve", "zo")]


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words that follow from the seed."""
    import random

    return lambda seed, n: " ".join(random.Random(seed).choices(WORDS, k=n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(table, prose):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rows = [
        (1, None, None, None, None), (1, "", "en", "a", 0), (None, "x", "en", "b", 1), (None, None, None, None, None), (2, prose(1, 40_000), "en", "a", 0),
        (3, prose(2, 30), "en", "a", 0), (3, prose(2, 30), "en", "a", 0), (3, prose(3, 30), "fr", None, 0), (4, "  \n\n ", "en", "b", 5), (5, "é🙂 ▁<s>\t\x00", "en", "b", 6),
    ]
    return table(rows)


@pytest.fixture(scope="session")
def no_docs(table):
    return table([])
