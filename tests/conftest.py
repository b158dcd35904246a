import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from sightline.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("sightline-tests", cpus=8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()
