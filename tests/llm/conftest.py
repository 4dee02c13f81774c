import pytest

from corpus_helpers import SCHEMA, make

from tabgauge.session import local_session

@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, repeated rows, equal ids, null ids, a very long text."""
    return [
        (5, None, None, None),
        (4, "", "en", "b"),
        (3, " \t\n ", "en", "b"),
        (7, "one", "en", "a"),
        (7, "one", "en", "a"),
        (7, "two other words", "en", None),
        (None, "one", None, "a"),
        (None, None, None, None),
        (9, "löng wörd \U0001f600 " * 4000, "de", "c"),
        (8, "x" * 5000, "fr", "c"),
        (2, "a  b\tc", "en", "b"),
        (1, "a b c", "en", "b"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
