import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture
def lake(spark, tmp_path):
    from tidemark.sources import Lakehouse

    return Lakehouse(spark, str(tmp_path), "test_catalog")


@pytest.fixture
def namespace():
    """A namespace no other test has used: the session catalog outlives a warehouse."""
    import uuid

    return f"ns_{uuid.uuid4().hex[:8]}"
