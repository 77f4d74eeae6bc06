import pytest

from hackney.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("hackney-tests", "8")
