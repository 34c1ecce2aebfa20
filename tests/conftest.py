from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from checks.compare import local_session  # noqa: E402
from voxspark.session import configure  # noqa: E402
from voxspark.sources import register  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = register(configure(local_session()))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
