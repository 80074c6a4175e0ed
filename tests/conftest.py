import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    session.sparkContext.environment["PYTHONPATH"] = here
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def same_rows(df, relation):
    """Whether a Spark result and a DuckDB result hold the same rows under the same names."""
    a, b = df.toArrow(), relation.to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    names = sorted(a.column_names)

    def rows(t):
        return sorted((tuple(_plain(v) for v in r) for r in zip(*(t.column(n).to_pylist() for n in names))), key=repr)

    assert rows(a) == rows(b)


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, list) else v
