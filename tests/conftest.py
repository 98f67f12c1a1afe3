import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=f"file://{base}/shared")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
