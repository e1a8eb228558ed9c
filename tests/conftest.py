"""A session for all tests."""

import pytest

from waylake.session import open_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = open_session("local[4]", "tests", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
