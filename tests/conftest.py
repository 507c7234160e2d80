"""One session for all tests, and SQL to compare with."""

import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return float(v) if isinstance(v, (int, float)) else str(v)


def same(df, relation):
    """Whether a DataFrame and a DuckDB relation hold the same rows, whatever their order."""
    names = relation.columns
    assert sorted(names) == sorted(df.columns)
    rows = [sorted((tuple(map(plain, r)) for r in x), key=str) for x in ([tuple(r[n] for n in names) for r in df.collect()], relation.fetchall())]
    assert rows[0] == rows[1]
