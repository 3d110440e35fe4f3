import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", 4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g")
    yield s
    s.stop()
