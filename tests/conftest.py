import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tests.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import prepare

    session = prepare(local_session())
    yield session
    session.stop()
