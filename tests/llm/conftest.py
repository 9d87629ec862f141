import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a DataFrame; texts may be null, further columns of clashing names are there on purpose."""

    def build(rows, ddl):
        return spark.createDataFrame([Row(*r) for r in rows], ddl)

    return build


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


LONG = "lorem ipsum dolor " * 30_000


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long and non-ASCII texts."""
    return [(1, None), (2, ""), (3, " \n"), (4, "same text"), (4, "same text"), (5, "same text"), (6, LONG), (None, "né 😀 x"), (7, "!!")]
