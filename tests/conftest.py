import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabgauge.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def orders(spark):
    return spark.read.parquet(f"{SF_DIR}/orders.parquet")


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


@pytest.fixture(scope="session")
def nulls(spark):
    rows = [(1.0, 2.0, "x"), (None, 4.0, None), (3.0, None, "y"), (None, None, None),
            (5.0, 10.0, "x"), (2.0, 5.0, None)]
    return spark.createDataFrame(rows, "a double, b double, s string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "a double, n bigint, s string")
