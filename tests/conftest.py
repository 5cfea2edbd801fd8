import pytest

from tracewell.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4)
