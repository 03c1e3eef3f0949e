import pytest

from lodestar.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("lodestar-tests", cores=8)
    yield session
    session.stop()
