import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": f"{tmp}/local",
        "spark.checkpoint.dir": f"{tmp}/shared",
        "spark.sql.warehouse.dir": f"{tmp}/warehouse",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle():
    """Rows of SQL over the smallest tables, by another engine."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return lambda sql: (r := con.sql(sql)).columns and shown([dict(zip(r.columns, x)) for x in r.limit(10_000_000).fetchall()])


def shown(rows):
    """Rows as sorted texts, columns by name; floats to six places."""
    one = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted("|".join(f"{k}={one(v)}" for k, v in sorted(r.items())) for r in rows)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: shown([r.asDict() for r in df.collect()])
