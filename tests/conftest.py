import pytest

from skein.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, driver_memory="4g")
    yield session
    session.stop()
