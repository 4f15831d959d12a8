import pytest
from llm_helpers import SCHEMA, messy_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """The same rows with more columns, of names that operators might use themselves."""
    for c in ("row", "k", "own", "gone", "t", "id", "take", "epoch", "domain", "part", "key", "bin", "h", "p", "__id", "__y", "__p_quality", "__co", "p_quality", "a b.c"):
        messy = messy.withColumn(c, F.lit(1))
    return messy


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
