"""One small session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("POINTLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from pointloom.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()
