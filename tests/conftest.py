import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__
    from parcelwise.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    return __spark_entry__.shipped(local_session(4, str(folder)))
