import pytest

from roadloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
