import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from likeness.session import drop_work_folders, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "likeness-tests", spark__sql__shuffle__partitions="4")
    yield s
    drop_work_folders(s)
    s.stop()
