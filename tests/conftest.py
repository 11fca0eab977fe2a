import pytest

from sparkbars import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("sparkbars-tests", 8, 4)
    yield session
    session.stop()
