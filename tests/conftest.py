import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from tidewatch.session import build_session, release

    s = build_session("local[*]", 8, "tidewatch-tests", checkpoint_dir=tempfile.mkdtemp(prefix="tests-"))
    yield s
    release(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
