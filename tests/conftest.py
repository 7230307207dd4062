from __future__ import annotations

import pytest

from seriatim.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests")
