import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graticule.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(2, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{folder}", spark__driver__memory="4g", spark__sql__warehouse__dir=str(folder / "warehouse"))
    yield session
    session.stop()
