import pytest

from boxrates.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=2)
