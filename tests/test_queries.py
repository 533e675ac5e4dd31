"""Every query with oracle SQL equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark.plans.oracle import oracle_sql
from tidemark.plans.queries import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name, tmp_path):
    df = queries()[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    if name not in oracle_sql():
        return
    ours = f"select {', '.join(sorted(df.columns))} from '{tmp_path}/out/*.parquet'"
    theirs = f"select {', '.join(sorted(df.columns))} from ({oracle_sql()[name]})"
    for a, b in ((ours, theirs), (theirs, ours)):
        assert db.sql(f"select count(*) from ({a} except all {b})").fetchall() == [(0,)]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
