import pytest

from issueloom.session import discard, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    discard(session)
