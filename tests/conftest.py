import pytest

from opsframe.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    return session


@pytest.fixture
def tiny_tasks(spark):
    """Pretend a task may only hold a handful of rows, so every key is hot."""
    spark.conf.set("opsframe.rowsPerTask", "7")
    yield
    spark.conf.unset("opsframe.rowsPerTask")


@pytest.fixture(params=["one task", "sliced"])
def both_ways(request, spark):
    """Run a test with whole keys per task and again with keys cut into slices."""
    if request.param == "sliced":
        spark.conf.set("opsframe.rowsPerTask", "7")
    yield request.param
    spark.conf.unset("opsframe.rowsPerTask")
