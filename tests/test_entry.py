import duckdb
import pytest

import __spark_entry__ as entry_module
from vigilog.plans.queries import QUERIES
import check

FAST = [n for n in entry_module.oracle_sql() if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["principalId", "sourceIPAddress", "accessKeyId"] and frame.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_oracle(spark, oracle, sf_dir, name):
    verdict, _ = check.compare(spark, oracle, sf_dir, name)
    assert verdict.startswith("ok"), verdict
