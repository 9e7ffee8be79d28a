import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = os.environ.get("INVLENS_TEST_SF", "/root/testdata/sf0.001")
SF_ORACLE = os.environ.get("INVLENS_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from invlens.session import build_session

    s = build_session(
        "local[*]",
        shuffle_partitions=8,
        app="invlens-tests",
        **{"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="invlens-wh-")},
    )
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="invlens-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="invlens-test-")
