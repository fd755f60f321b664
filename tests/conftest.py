import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tamizal.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
