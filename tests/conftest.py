import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query's rows with those of DuckDB over the same tables, in any order."""
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")

    def plain(frame, columns):
        frame = frame[columns].astype(object)
        return sorted(tuple(None if pd.isna(v) else str(v) for v in row) for row in frame.itertuples(index=False))

    def check(result, sql):
        got, want = result.toPandas(), connection.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda rows: sorted(rows, key=str)
        assert key(plain(got, columns)) == key(plain(want, columns))

    return check
