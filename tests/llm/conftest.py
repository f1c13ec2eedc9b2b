import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A small table from rows and a schema string, in more than one partition."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
