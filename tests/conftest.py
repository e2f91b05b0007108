from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.fixture(scope="session")
def same(spark, oracle):
    """Compares a query with its SQL, regardless of the order of rows and columns."""

    def check(query, sql: str, sf: str = SF) -> int:
        got = query(spark, sf)
        columns = sorted(got.columns)
        rows = [tuple(r[c] for c in columns) for r in got.collect()]
        want = oracle.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        order = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(rows, key=order) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=order)
        return len(rows)

    return check
