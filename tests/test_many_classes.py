"""A repository may hold more classes than places of methods fit into 32 bits: 10,000 places for each class."""

from pyspark.sql import functions as F

from structcheck.plans import bridge

N = 214_751


def test_places_of_methods_are_long(spark, tmp_path):
    spark.range(1, N + 1).selectExpr("id p_partkey", "'x' p_name", "'Brand#11' p_brand", "'t' p_type", "CAST(id % 50 AS INT) p_size", "1.0D p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    line = "id l_orderkey", f"{N} l_partkey", "id l_suppkey", "3 l_linenumber", "30D l_quantity", "1D l_extendedprice", "0.05D l_discount", "0.01D l_tax", "'A' l_returnflag", "'F' l_linestatus", "timestamp'2020-01-01' l_shipdate"
    spark.range(2).selectExpr(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    m = bridge.instance(spark, str(tmp_path), keep=("methods",))
    assert [r["ord"] for r in m.method.orderBy("ord").collect()] == [(N - 1) * 10_000 + i for i in (1, 2)]
    assert m.local_methods.select(F.count("method")).first()[0] == 2
