import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from evalweave.session import local_session

    return local_session(4, "tests", **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})


@pytest.fixture
def make(spark):
    """make(schema, row, row, ...): a small table."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
