import pytest

from geolith.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="3g")
    ship_package(session)
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
