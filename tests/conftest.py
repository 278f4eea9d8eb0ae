import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def same():
    """Rows of a query and of its SQL, columns by name, in any order."""
    import glob

    import duckdb
    import numpy as np

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def rows(df):
        df = df[sorted(df.columns)]
        one = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
        return sorted(repr([one(None if type(v).__name__ in ("NAType", "NaTType") else v) for v in r]) for r in df.itertuples(index=False, name=None))

    def check(df, sql):
        a, b = df.toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
