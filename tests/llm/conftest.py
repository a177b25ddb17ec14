import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, part string, key string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns whose names an operator might use itself."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon for a long while."), (1, "The cat sat on the mat and looked at the moon for a long while."),
        (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long + " end"), (None, "No id here, but some words."), (None, None), (7, "one"), (8, "ONE"), (9, "bad!! WORDS!! HERE!!"),
        (10, "x" * 100_000), (11, "é ü \U0001f600   mixed"), (12, "The cat sat on the mat and looked at the moon for a long while."),
    ]
    return spark.createDataFrame([(i, t, None, "s", 0, "x", "y", None, "k", "l") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, None), (2, None, None), (None, 1, 1), (9, 0, 1), (5, 1, 0), (77, 1, 1), (10, 7, -1), (12, 1, 0), (7, 0, 1)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")
