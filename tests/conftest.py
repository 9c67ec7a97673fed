import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Chunks of a few rows, so every halo and carry is exercised."""
    spark.conf.set("tidewater.chunk.rows", "7")
    yield
    spark.conf.unset("tidewater.chunk.rows")
