import pytest

from . import data


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Read from files, as the operators read their tables."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(data.rows(), data.SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], data.SCHEMA)
