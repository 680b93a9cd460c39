"""Documents in parts give what the same documents give as one value, and no part holds a whole repository."""

import duckdb
import pytest

from structcheck.plans import oracle, queries
from structcheck.sources import extraction

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def small_parts(monkeypatch):
    monkeypatch.setattr(queries, "PART", 3)


def test_a_value_holds_a_part_of_a_repository(spark, small_parts):
    documents = queries._extraction(spark, SF)
    sizes = documents.selectExpr("repo", "size(from_json(value, 'types array<struct<qualifiedName:string>>').types) AS n").collect()
    assert max(r["n"] for r in sizes) == 3 and len(sizes) > len({r["repo"] for r in sizes})


@pytest.mark.parametrize("name", "load_types map_method map_binding map_attribute rel_parents type_count sort_types extraction_json aie_render map_either_shape param_signature".split())
def test_parts_equal_the_sql(spark, small_parts, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({oracle.oracle_sql()[name]})").fetchall())


def test_parts_without_types_and_types_of_one_name(spark):
    t = '{"qualifiedName":"a.B","executables":[{"name":"f"},{"name":"g","abstractExecutable":true}],"fields":[{"name":"x"}]}'
    u = '{"qualifiedName":"a.A","fields":[{"name":"y"}]}'
    v = '{"executables":[{"name":"h"}]}'
    whole = spark.createDataFrame([("r", '{"types":[%s]}' % ",".join((t, u, t, v)))], "repo string, value string")
    parts = [(0, [t]), (1, []), (2, [u, t]), (4, [v])]
    cut = spark.createDataFrame([("r", n, '{"types":[%s]}' % ",".join(x)) for n, x in parts] + [("r", 3, "no json")], "repo string, part int, value string")
    assert rows(extraction.load_types(cut)) == rows(extraction.load_types(whole))
    assert extraction.load_types(cut).schema == extraction.load_types(whole).schema
    assert rows(extraction.in_order(cut)) == rows(extraction.in_order(whole))
    assert [r["qualifiedName"] for r in extraction.in_order(cut).orderBy("pos").collect()] == [None, "a.A", "a.B", "a.B"]
    assert rows(extraction.load_types(cut, either=True)) == rows(extraction.load_types(whole, either=True))
    again = extraction.to_documents(extraction.load_types(whole), size=3)
    assert again.count() == 2 and rows(extraction.load_types(again)) == rows(extraction.load_types(whole))
