import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with views of the sf0.01 tables, at which every derived table has rows."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(f"{TESTDATA}/sf0.01"):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/sf0.01/{name}'")
    return con


def rows_of(frame):
    """Sorted rows of a pandas frame, columns by name, doubles to six digits."""

    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "__len__") and not isinstance(v, str):
            return tuple(map(plain, v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(zip(*[[plain(v) for v in frame[c].tolist()] for c in frame.columns]), key=repr)
