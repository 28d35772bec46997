import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="marquee-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    from marquee.sources.adapter import driver_tables
    return driver_tables(spark, SF0001)
