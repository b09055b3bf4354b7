import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidecast.session import build_session

    ckpt = tempfile.mkdtemp(prefix="tidecast-test-")
    s = build_session("local[4]", app="tidecast-tests",
                      extra={"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tidecast-t-")
