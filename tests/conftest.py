import pytest

from leafmill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, "6g"))
