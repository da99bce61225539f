import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quorix.session import build_session, shared_dir, ship

    session = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(ship(session))
    yield session
    session.stop()
