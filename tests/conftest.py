import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelcast.session import build_session, checkpoint_dir

    s = build_session("local[4]", app="panelcast-tests", shuffle_partitions=4,
                      extra={"spark.ui.showConsoleProgress": "false"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-test-ckpt-"))
    checkpoint_dir(s)
    yield s
    s.stop()
