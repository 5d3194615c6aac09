from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def assert_same(df, frame) -> None:
    """The same columns and rows, in any order."""
    got = df.toPandas()
    assert sorted(got.columns) == sorted(frame.columns)
    columns = sorted(got.columns)
    rows = lambda x: sorted((tuple(_plain(v) for v in r) for r in x[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(frame)


@pytest.fixture(scope="session")
def same():
    return assert_same
