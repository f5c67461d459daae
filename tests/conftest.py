import itertools
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def engine(spark, tmp_path):
    from stratum.engine import Engine

    ticks = itertools.count(1_700_000_000_000, 1000)
    return Engine.init(spark, str(tmp_path / "root"), clock=lambda: next(ticks))


@pytest.fixture
def do(engine):
    """Apply operations as one plan."""

    def run(*operations, message="m", base=None):
        return engine.apply({"baseSchemaHash": base or engine.schema_hash(), "message": message, "operations": list(operations)})

    return run
