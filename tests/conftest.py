import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskboard.session import build  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build("riskboard-tests", "local[8]", spark__sql__shuffle__partitions="8",
                    spark__ui__enabled="false", spark__driver__memory="6g",
                    spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def board_path():
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "board.json")


@pytest.fixture
def rows():
    """Sorted plain tuples of a frame, columns as asked for."""
    def take(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=repr)
    return take
