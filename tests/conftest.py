import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark

    s = get_spark(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
