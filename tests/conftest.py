import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from convlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, app="tests")
    yield s
    s.stop()
