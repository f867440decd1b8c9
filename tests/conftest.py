import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tickweave.session import local_session

    session = local_session(8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_bins():
    """Makes nearly every group of a test large enough to be cut into bins."""
    from tickweave.operators.spread import Spread

    return Spread(min_rows=5, rows_per_bin=3, max_groups=1000)
