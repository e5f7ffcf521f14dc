import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lucarne import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]",
        **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "6g", "spark__ui__showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows(spark):
    """``rows([(..), ..], "schema")`` as a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)
