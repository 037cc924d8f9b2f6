import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pluvia.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("pluvia-tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """rows('a int, b string', (1, 'x'), ...) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
