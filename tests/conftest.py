import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import open_duckdb  # noqa: E402
from vantry.session import TableStore, local_session  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4)


@pytest.fixture(scope="session")
def store(spark):
    return TableStore(spark, "tests")


@pytest.fixture(scope="session")
def con():
    return open_duckdb(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
