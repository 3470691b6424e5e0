import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from coachload.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="coachload-tests", shuffle_partitions=8)
    # tests own their checkpoint folder only where the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        checkpoint_dir(s, tempfile.mkdtemp(prefix="coachload-test-ckpt-"))
    yield s
    s.stop()
