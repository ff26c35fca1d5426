import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shelfcast.session import build_session

    import __spark_entry__  # noqa: F401  (functions travel with the job)

    session = build_session(
        "tests",
        "local[8]",
        spark_sql_shuffle_partitions="8",
        spark_driver_memory="6g",
        spark_ui_enabled="false",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
