import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepost.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="module")
def interpreted(spark):
    """Plans of many steps over a few rows: compiling each step would take longer than running it."""
    options = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for name, value in options.items():
        spark.conf.set(name, value)
    yield
    for name in options:
        spark.conf.unset(name)
