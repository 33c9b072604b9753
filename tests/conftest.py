from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hookflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "hookflow-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="hookflow-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def table(spark):
    """Rows and a DDL layout to a DataFrame."""
    return lambda rows, layout: spark.createDataFrame(rows, layout)
