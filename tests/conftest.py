import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scrubjay.session import build_session
    ckpt = tempfile.mkdtemp(prefix="scrubjay-test-ckpt-", dir="/tmp")
    s = build_session("local[4]", app="scrubjay-tests", shuffle_partitions=8,
                      extra={"spark.ui.enabled": "false", "spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="scrubjay-test-", dir="/tmp")
