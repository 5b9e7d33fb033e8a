import pytest

from quillspan.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g", "tests")
    s.sparkContext.setLogLevel("OFF")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
