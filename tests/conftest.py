import logging
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablecheck.session import local_session  # noqa: E402

logging.getLogger("SQLQueryContextLogger").disabled = True


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
