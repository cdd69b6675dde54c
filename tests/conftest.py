from __future__ import annotations

import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4, memory="6g")
