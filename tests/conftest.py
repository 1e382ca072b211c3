import pytest

from tunemill.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
