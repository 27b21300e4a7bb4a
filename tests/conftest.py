import pytest

from plumbline.session import local_session
from tests.compare import TESTDATA, duck


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)
