from __future__ import annotations

import tempfile

import pytest

from tallybrook.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


def plan_of(frame) -> str:
    """Executed plan as text."""
    return frame._jdf.queryExecution().toString()
