import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from telemark.session import get_session

    s = get_session("local[4]", 4, extra={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
