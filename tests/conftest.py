import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import get_session
    ck = tempfile.mkdtemp(prefix="cohortlab-test-ckpt-")
    s = get_session("local[4]", app="cohortlab-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": ck})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)
