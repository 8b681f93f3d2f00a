import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rotaloom.session import build_session

    session = build_session("local[4]", app="tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    from rotaloom.session import reachable

    reachable(session)
    yield session
    session.stop()
