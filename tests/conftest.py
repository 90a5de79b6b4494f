import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from verdigris.session import forget, get_session

    s = get_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    forget(s)
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d
