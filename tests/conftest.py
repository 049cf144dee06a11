import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same_rows(left, right):
    """Compares two pandas tables regardless of order, by text of their values."""
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return v if isinstance(v, str) else repr(round(float(v), 6))

    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = [sorted(tuple(map(one, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)) for df in (left, right)]
    assert rows[0] == rows[1]
