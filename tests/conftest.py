import pytest

from labelloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=4, memory="4g")
