import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import session  # noqa: E402
from textlabels.sources.workspace import release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session_ = session()
    yield session_
    release(session_)
    session_.stop()
