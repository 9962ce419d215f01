import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd
import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(spark_frame, duck_frame):
    """Both results as sorted tuples of strings, columns by name."""

    def told(v):
        if pd.isna(v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return repr(float(v)) if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    rows = [sorted(tuple(map(told, r)) for r in f[sorted(f.columns)].astype(object).values.tolist()) for f in (spark_frame, duck_frame)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf_dir):
        c = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return c

    return connect
