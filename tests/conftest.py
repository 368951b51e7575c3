from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import local_session

    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def book(spark):
    from trades_fixture import build

    return build(spark)
