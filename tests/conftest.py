import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pavilion.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pavilion-test-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a frame from dicts under a DDL schema; missing keys are NULL."""

    def build(data, ddl):
        names = [c.split()[0] for c in ddl.split(",")]
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], ddl)

    return build
