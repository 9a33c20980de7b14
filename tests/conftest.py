import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postglean.session import local_session  # noqa: E402
from postglean.sources.tables import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "3g")
    ship_package(s)
    yield s
    s.stop()
