from __future__ import annotations

import os

import pytest

from kartei.session import build_session

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny() -> str:
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
