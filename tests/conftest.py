import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from verdigris.session import local_session

    session = local_session(cores=8, memory="8g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf(spark):
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)


@pytest.fixture
def value(spark):
    """Evaluate one column over one row of named values."""

    def run(column, schema="x INT", row=(0,)):
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run
