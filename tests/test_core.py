"""Small models and texts with known outcomes."""

import pytest
from pyspark.sql import functions as F

from structcheck.functions import text
from structcheck.operators import catalog, closure, rules
from structcheck.sources import extraction, instance_text, python_source
from structcheck.streaming import progress


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_of_a_diamond_and_a_cycle(spark):
    edges = spark.createDataFrame([("r", "d", "b", 1), ("r", "d", "c", 2), ("r", "b", "a", 1), ("r", "c", "a", 1), ("s", "x", "y", 1), ("s", "y", "x", 1)], "repo string, cls string, parent string, ord int")
    assert rows(closure.ancestors(edges)) == sorted([("r", "d", "b"), ("r", "d", "c"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "a"), ("s", "x", "y"), ("s", "y", "x"), ("s", "x", "x"), ("s", "y", "y")])
    assert rows(closure.first_parent(edges).filter("repo = 'r' AND cls = 'd'")) == [("r", "d", "b")]
    assert closure.ancestors(edges.limit(0)).count() == 0


def test_verdict_keeps_clean_repositories(spark):
    found = spark.createDataFrame([("a", "i", "c", "s", "d")], "repo string, invariant string, check_name string, subject string, description string")
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    assert rows(rules.verdicts(found, repos)) == [("a", "UNSAT", 1), ("b", "SAT", 0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("f", "String, int"), ("f", "int,String"), ("g", ""), ("h", None)], "n string, p string")
    assert [r[0] for r in df.select(text.method_key(F.col("n"), F.col("p"))).collect()] == ["f(String,int)", "f(String,int)", "g", "h"]
    urls = ["https://Example.com/a/b.git", "http://example.com/a/b", "https://example.com/a", "https://u@example.com/a/b", "https://example.com/a/b?x=1", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(text.repository_url(F.col("u"))).collect()
    assert [r[0] for r in got] == ["https://example.com/a/b", None, None, None, None, None]


def test_extraction_document(spark):
    doc = '{"types":[{"qualifiedName":"a.B","abstractType":"false","executables":[{"name":"B","constructor":true},{"name":"m","visibility":"PRIVATE","parameters":[{"type":"int"},{"type":"T"}]}]},{"qualifiedName":"a.C","superClass":"a.B","abstractType":true,"fields":[{"name":"x"}]}]}'
    types = extraction.load_types(spark.createDataFrame([("r", doc), ("s", "no json"), ("t", "{}")], "repo string, value string"))
    assert rows(extraction.classifiers(types).select("repo", "cls", "cid", "is_abstract")) == [("r", "Classifier0", "a_B", "No"), ("r", "Classifier1", "a_C", "Yes")]
    m = extraction.methods(types)
    assert rows(m.select("method", "return_type", "param_types", "is_inheritable")) == [("Method1", "void", "int, T", "No")]
    assert rows(extraction.parents(types)) == [("r", "Classifier1", "Classifier0")]
    assert rows(extraction.bindings(types).select("binding", "target")) == [("ImplementationBinding0", "Method1")]
    assert rows(extraction.attributes(types).select("attribute", "type", "scope")) == [("Attribute0", "Object", "Instance")]


def test_instance_text(spark):
    value = 'x\nRoot = {\n-- note\nclassifiers = {A}\nA = { cid = "1", name = "n, m" }\nB = {\n  name = "x, y",\nparents[A] = { B, B, null }\nbody[A] = B,\n}\nC = { cid = "2" }'
    found = instance_text.lines(spark.createDataFrame([("r", value)], "repo string, value string"))
    assert rows(instance_text.atoms(found).select("atom")) == [("A",), ("B",)]
    assert rows(instance_text.attrs(found)) == [("r", "A", "cid", "1"), ("r", "A", "name", "n"), ("r", "B", "name", "x, y")]
    assert rows(instance_text.tuples(found).select("relation", "src", "dst")) == [("body", "A", "B"), ("parents", "A", "B")]


def test_python_source():
    found = python_source.types_of("import abc\nclass A(abc.ABC):\n  class N: pass\nclass B(A, C): pass\n")
    assert [(t["qualifiedName"], t["kind"], t["superClass"]) for t in found] == [("A", "interface", None), ("A.N", "class", None), ("B", "class", "A")]
    assert python_source.types_of("class (") == []
    t = python_source.types_of("class K(Exception, lib.M, N, G[int], metaclass=abc.ABCMeta):\n  x: p.T = 1\n  _a__b = _c = 2\n  def __init__(self, n: int): ...\n  @classmethod\n  def of(cls, q, r: R) -> K: ...\n  async def no(self): ...\n  def f(self):\n    class L: ...\n")
    assert [(x["qualifiedName"], x["kind"], x["superClass"], x["interfaces"]) for x in t] == [("K", "interface", "M", ["N", ""]), ("K.L", "class", None, [])]
    assert [(f["name"], f["type"], f["visibility"]) for f in t[0]["fields"]] == [("x", "T", "public"), ("_a__b", "unknown", "public"), ("_c", "unknown", "protected")]
    assert [(e["name"], e["returnType"], e["visibility"], e["constructor"], e["staticExecutable"], [p["type"] for p in e["parameters"]]) for e in t[0]["executables"]] == [
        ("__init__", "None", "private", True, False, ["int"]), ("of", "K", "public", False, True, ["unknown", "R"]), ("f", "None", "public", False, False, []),
    ]


def test_criteria():
    for bad in ({"limit": 0, "language": "x"}, {"min_stars": 3, "max_stars": 1}, {}):
        with pytest.raises(ValueError):
            catalog.Criteria(**bad)


def test_timeline_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'view' AS event_type UNION ALL SELECT timestamp'2024-01-01 10:55:00', 'view'").write.parquet(src)
    stream = progress.timeline(spark.readStream.schema("ts timestamp, event_type string").parquet(src), "1 hour")
    q = stream.writeStream.format("memory").queryName("timeline").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("SELECT n FROM timeline").collect()] == [2]
