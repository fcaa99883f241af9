import pytest

from tests.llm.data import SCHEMA, documents


@pytest.fixture(scope="session")
def odd_rows():
    return documents()


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """The odd documents as a Parquet folder of several files."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
