import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import get_spark, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[2]", shuffle_partitions=4)
    yield s
    release_scratch(s)
    s.stop()
