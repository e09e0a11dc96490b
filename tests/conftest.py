import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trailweave.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, spark__checkpoint__dir=f"file://{shared}", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
