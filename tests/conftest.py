import pytest

from factweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    yield s
    s.stop()
