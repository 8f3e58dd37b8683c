import glob
import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from fieldloom.session import local_session  # noqa: E402
from small_data import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    session.conf.set("spark.fieldloom.state.buckets", "3")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Limits that make any key with more than 12 rows hot."""
    limits = {"groupRows": "12", "pieceRows": "5"}
    for name, value in limits.items():
        spark.conf.set(f"spark.fieldloom.skew.{name}", value)
    yield
    for name in limits:
        spark.conf.unset(f"spark.fieldloom.skew.{name}")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con
