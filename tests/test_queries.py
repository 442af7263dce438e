"""Each core query against its SQL on the smallest tables, and on empty ones."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = sorted(entry.core_queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(x) for x in value])
    try:
        return f"{float(value):.6g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def content(df):
    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.core_queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert content(got) == content(want)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(folder / os.path.basename(path)))
    return str(folder)


@pytest.mark.parametrize("name", ["p1_found", "p1_table", "p2_found", "p3_found", "p5_found", "p5_history", "p6_found", "momentum_score", "rsi2_wilder", "detect_base", "persistence_streak", "replay_target_stop", "sector_edge", "min_cost_cover"])
def test_empty(spark, empty, name):
    assert entry.core_queries()[name](spark, empty).count() == 0
