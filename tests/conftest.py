import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphloom.session import get_session

    where = tmp_path_factory.mktemp("spark")
    session = get_session("tests", "local[8]", spark__sql__warehouse__dir=str(where / "wh"), spark__checkpoint__dir=f"file://{where}/shared")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL
