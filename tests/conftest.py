import pytest

from kinweave.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    """A table from rows and a schema in DDL."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
