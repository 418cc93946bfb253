"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compare a Spark and a DuckDB result as sorted rows, floats to nine digits."""

    def canon(df):
        cols = sorted(df.columns)
        rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)
        text = lambda v: "" if v is None else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return cols, sorted(tuple(map(text, r)) for r in rows)

    def check(a, b):
        (ca, ra), (cb, rb) = canon(a), canon(b)
        assert ca == cb
        assert ra == rb

    return check
