import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohera.session import get_session

    s = get_session("local[4]", 4, app_name="cohera-tests")
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
