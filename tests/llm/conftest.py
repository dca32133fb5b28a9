import pytest

TRICKY = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n"),
    (4, "one"),
    (5, "one"),
    (6, "Ünïcode ſtraße “quotes” 漢字 " * 3),
    (7, "word " * 30_000),
    (7, "a repeated id with another text, which is a row of its own"),
    (None, "a row without an id"),
    (8, "\n".join(f"line {i} of a text" for i in range(300))),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", 5, 1.5, "x") for i, t in TRICKY]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, score double, node string")


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
