import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare():
    """Runs a query and its SQL over a sample folder and compares all rows exactly."""
    import glob

    import duckdb
    import pandas as pd

    def rows(df):
        cols = sorted(df.columns)
        text = lambda v: "None" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
        return cols, sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False))

    def run(frame, sql, sf_dir):
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        assert rows(frame.toPandas()) == rows(con.sql(sql).df())

    return run
