import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quillmesh.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 2, "tests")
    session.sparkContext.setLogLevel("OFF")
    # a hundred small jobs: what they compute is the same, they only start faster
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
