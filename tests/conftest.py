from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()
