import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from repolens.session import build_session

    session = build_session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
