import pytest

from tonewright.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
