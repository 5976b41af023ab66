import pytest

from ridgeline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "ridgeline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
