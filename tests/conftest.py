import pytest

from worklens.plans.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
