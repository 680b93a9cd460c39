"""Methods and their tuples are dealt over more tasks where there are more of them."""

import duckdb
import pytest

from structcheck.functions import tables
from structcheck.plans import bridge, oracle, queries

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    cls = bridge.classifiers(spark, SF)
    few = bridge.methods(spark, SF, cls).rdd.getNumPartitions()
    monkeypatch.setattr(tables, "ROWS", 200)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert few <= 4 and bridge.methods(spark, SF, cls).rdd.getNumPartitions() == -(-rows // 200)


@pytest.mark.parametrize("name", ["binding_wide", "available_members"])
def test_same_rows_when_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS", 500)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({oracle.oracle_sql()[name]})").fetchall())
