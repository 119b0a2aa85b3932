import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from consonance.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=8, app="consonance-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="consonance-test-ckpt-"))
    yield s
    s.stop()
