import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from newsflow.session import build_session, clear_scratch
    # tests set their own shared folder; library code only reads it
    ckpt = tempfile.mkdtemp(prefix="newsflow-test-ckpt-")
    s = build_session("local[4]", app="newsflow-tests", shuffle_partitions=8,
                      conf={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    clear_scratch(s)
    s.stop()
