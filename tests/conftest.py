from __future__ import annotations

import pytest

from shoplight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "shoplight-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
