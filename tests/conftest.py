from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gpsight.session import build_session

    session = build_session("local[4]", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables01(spark):
    from gpsight.sources.store import practice_tables

    return practice_tables(spark, SF01)
