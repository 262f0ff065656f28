import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from trailmark.session import checkpoint_dir, local_session
    from trailmark.streaming.live import use_rocksdb

    session = local_session("4", "trailmark-tests", "4g")
    checkpoint_dir(session)
    use_rocksdb(session)
    yield session
    session.stop()
