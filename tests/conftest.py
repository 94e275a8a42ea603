import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from notewright.session import local_session

    return local_session(8, 4, driver_memory="6g", app="tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
