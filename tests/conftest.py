import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALLEST, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from velumra.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="2g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
