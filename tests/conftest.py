from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from topicloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "topicloom-tests", "6g")


@pytest.fixture(scope="session")
def rows():
    """Collect a DataFrame as a sorted list of tuples."""
    return lambda df, *columns: sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
