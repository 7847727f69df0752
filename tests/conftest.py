"""One Spark session for all tests; the workers' PYTHONPATH leads to the repository."""

import pytest

from tests.oracle import session


@pytest.fixture(scope="session")
def spark():
    found = session()
    found.conf.set("spark.sql.shuffle.partitions", "4")
    yield found
    found.stop()


SMALL = "/root/testdata/sf0.001"
