import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from locusframe.session import local_session, ship

    s = local_session(cores="4", shuffle=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
