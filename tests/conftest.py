import pytest

from kgloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="3g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
