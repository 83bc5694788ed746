import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import discard_tables, local_session  # noqa: E402

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield session
    discard_tables(session)
    session.stop()
