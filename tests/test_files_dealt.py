"""Files that lie in one partition are read by several tasks."""

from pyspark.sql import functions as F

from structcheck.sources import declarations, python_source


def files(spark, content):
    return spark.range(64, numPartitions=1).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit(content).alias("content"))


def test_python_files(spark):
    found = python_source.extract(files(spark, "class A:\n    pass\n"))
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 64


def test_files_of_other_languages(spark, monkeypatch):
    seen = []
    kept = declarations.pieces
    monkeypatch.setattr(declarations, "pieces", lambda f, language: seen.append(f.select(F.spark_partition_id()).distinct().count()) or kept(f, language))
    for types, text in ((declarations.java_types, "class A { int x; }"), (declarations.cpp_types, "class A { public: int x; };")):
        found = types(files(spark, text))
        assert found.count() == (64 if types is declarations.java_types else 1)
    assert min(seen) > 1
