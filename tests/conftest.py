from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tzinfo") and hasattr(v, "hour"):
        return v.replace(tzinfo=None)
    return v


def rows_of(df, columns):
    return sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL twin over the small tables."""

    def check(query, sql):
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        want = sorted(repr(tuple(norm(v) for v in r)) for r in rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert rows_of(df, columns) == want

    return check
