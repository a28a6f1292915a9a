from __future__ import annotations

import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (bool, int)) else str(value)


def same_rows(df, sql: str, sf: str = SF):
    """Rows of the Spark result and of the SQL, as sorted lists."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    assert set(names) <= set(df.columns), (names, df.columns)
    want = [tuple(map(normal, r)) for r in found.fetchall()]
    got = [tuple(map(normal, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return sorted(got, key=str), sorted(want, key=str)
