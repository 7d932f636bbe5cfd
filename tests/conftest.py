import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from daytally.session import local_session  # noqa: E402
from daytally.sources.transactions import Transactions  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RAW_TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "4g")
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole scan descriptions in plans
    yield session
    session.stop()


@pytest.fixture(scope="session")
def source(spark):
    return Transactions(spark, DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con
