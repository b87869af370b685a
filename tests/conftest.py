import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidestock.session import build_session  # noqa: E402
from tidestock.sources.tables import remove_stages  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_stages(session)
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a small frame from a DDL schema and tuples."""
    return lambda ddl, *data: spark.createDataFrame(list(data), ddl)
