import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _session() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("keyedflow-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


def pytest_configure(config):
    # Columns such as path("id") in test modules need a session when they are imported.
    _session()


@pytest.fixture(scope="session")
def spark():
    return _session()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="keyedflow-test-")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
