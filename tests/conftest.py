from __future__ import annotations

import pytest
from check import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
