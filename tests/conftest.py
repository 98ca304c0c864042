import pytest
from pyspark.sql import SparkSession

from trapline.settings import SESSION_OPTIONS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
    )
    for name, value in SESSION_OPTIONS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return SMALL


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
