"""Reports over every rule of the registry, against their SQL."""

import duckdb
import pytest

from structcheck.operators import rules
from structcheck.plans import oracle, queries

SF = "/root/testdata/sf0.001"


def test_all_rules_are_in_the_sql():
    assert set(rules.REGISTRY) == set(oracle.INVARIANTS | oracle.OTHER_INVARIANTS)
    assert all(rules.REGISTRY[n].invariant == i for n, i in (oracle.INVARIANTS | oracle.OTHER_INVARIANTS).items())


@pytest.mark.parametrize("name", ["whole_verdict", "whole_matrix", "whole_dead"])
def test_whole_reports(spark, name):
    con = duckdb.connect()
    for t in "part lineitem customer orders events documents pages".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({oracle.oracle_sql()[name]})").fetchall())
