import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from support import SF, TABLES

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(df, columns):
    return sorted((repr([plain(v) for v in row]) for row in df.select(*columns).collect()))


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Holds a query against its SQL: names, number of rows and values."""

    def check(query, sql, sf_dir=SF, con=duck):
        df = query(spark, sf_dir)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        expected = sorted(repr([plain(v) for v in row]) for row in found.fetchall())
        assert rows_of(df, names) == expected

    return check
