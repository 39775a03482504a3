import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from permlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Small parts are not merged here, so that the operators that work over ordered parts meet several of them.
    settings = {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    session = build_session("4", "permlens-tests", **settings)
    yield session
    session.stop()
