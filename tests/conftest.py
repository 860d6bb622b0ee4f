import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def duck():
    return database(DATA)


def plain(value):
    """A value in a form that both engines share."""
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__module__ in ("numpy", "decimal"):
        return str(round(float(value), 6) + 0.0) if not isinstance(value, str) else value
    return str(value)


def rows_of(frame):
    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL."""

    def check(query, sql, folder=DATA):
        got, expected = query(spark, folder).toPandas(), (duck if folder == DATA else database(folder)).execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)

    return check
