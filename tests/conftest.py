import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{round(value, 5) + 0.0:.5f}"
    return str(value)


def rows(frame):
    """The rows of a pandas frame or a Spark one, as sorted strings by column name."""
    frame = frame.toPandas() if hasattr(frame, "toPandas") else frame
    names = sorted(frame.columns)
    out = []
    for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False):
        out.append(tuple(cell(v) for v in row))
    return names, sorted(out)
