import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables and compares the rows."""
    import duckdb
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")

    def cell(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    def rows(pdf):
        cols = sorted(pdf.columns)
        out = [tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
        return cols, sorted(tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in out)

    def run(query, sql):
        got, want = rows(query(spark, folder).toPandas()), rows(con.execute(sql).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return run
