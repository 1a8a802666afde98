import sys

import pytest

from tests import oracle

sys.path.insert(0, oracle.ROOT)


@pytest.fixture(scope="session")
def spark():
    return oracle.session()
