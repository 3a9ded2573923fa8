import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gristmill.session import local_session

    os.environ.setdefault("GRISTMILL_DRIVER_MEMORY", "4g")
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"))
    yield session
    session.stop()
