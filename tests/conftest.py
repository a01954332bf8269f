from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from framequarry.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__local__dir=tempfile.mkdtemp(prefix="spark-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
