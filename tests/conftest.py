import os
import tempfile
import time

import pytest

os.environ["TZ"] = "UTC"
time.tzset()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = SparkSession.builder.master("local[8]").appName("tests").config(map={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1",
        "spark.sql.warehouse.dir": f"{place}/warehouse", "spark.local.dir": f"{place}/local", "spark.checkpoint.dir": f"file://{place}/shared", "spark.ui.showConsoleProgress": "false",
    }).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the tables of one folder."""
    import duckdb

    def opened(sf_dir: str):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for name in sorted(os.listdir(sf_dir)):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
        return con

    return opened
