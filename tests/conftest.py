import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from martlight.session import local_session  # noqa: E402
from martlight.sources.star import load_star  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return load_star(spark, SF)


@pytest.fixture
def many_ranges(spark):
    """Keep small data spread over several partitions, so that range offsets are exercised."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")
