import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from arbora.session import local_session, ship

    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    ship(s)
    yield s
    s.stop()
