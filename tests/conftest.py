import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from moorgrid.session import local_session

    return local_session(4, shuffle_partitions=4, driver_memory="4g")


@pytest.fixture(scope="session")
def data():
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("test tables are not here")
    return str(d)
