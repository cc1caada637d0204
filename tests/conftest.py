from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v if v is None or isinstance(v, bool | int | str) else str(v)


def rows_of(columns, rows):
    """The rows with columns in order of name, sorted."""
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], sorted((tuple(_plain(r[n]) for n in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a Spark query against SQL."""

    def check(query, sql):
        df = query(spark, DATA)
        got = rows_of(df.columns, df.collect())
        found = duck.execute(sql)
        want = rows_of([c[0] for c in found.description], found.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
