from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusqa.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(df, *columns):
    """Rows of a frame as a sorted list of tuples."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
