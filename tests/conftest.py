"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from seriatim.session import build, ship

    s = build("tests", cores=4, partitions=4)
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    return "/root/testdata/sf0.001"
