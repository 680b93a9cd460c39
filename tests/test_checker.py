"""The checker's outcome on small models, each with one flaw, read from instance text; and the sources and sinks around it."""

import json

import pytest
from pyspark.sql import functions as F

from structcheck.functions import numbers
from structcheck.operators import catalog, rules
from structcheck.sources import catalog_pages, extraction, instance_text, listing, other_languages, python_source, sinks


def cls(*names, abstract=()):
    return [f'Classifier{i} = {{ cid = "{n}", name = "{n}", isAbstract = {"Yes" if i in abstract else "No"} }}' for i, n in enumerate(names)]


def met(i, name="m", mid=None, kind="void", inheritable="Yes", scope="Instance", abstract="No"):
    return f'Method{i} = {{ mid = "{mid or f"M{i}"}", memberName = "{name}", returnType = "{kind}", paramTypes = "_", isInheritable = {inheritable}, scope = {scope}, isAbstract = {abstract} }}'


def rel(name, src, *dst):
    return f"{name}[Classifier{src}] = {{ {', '.join(f'{"Classifier" if name == "parents" else "Method"}{d}' for d in dst)} }}"


def bind(i, owner, target):
    n = f"ImplementationBinding{i}"
    return [f"MethodBody{i} = {{ }}", f"implementer[{n}] = {{ Classifier{owner} }}", f"target[{n}] = {{ Method{target} }}", f"body[{n}] = {{ MethodBody{i} }}"]


CASES = {
    "clean": (cls("A"), {}),
    "class id": ([*cls("A"), 'Classifier1 = { cid = "A", name = "B", isAbstract = No }'], {"IdentifierIntegrity": 1}),
    "class name": ([*cls("A"), 'Classifier1 = { cid = "B", name = "A", isAbstract = No }'], {"IdentifierIntegrity": 1}),
    "method id": ([*cls("A"), met(0, mid="M"), met(1, "n", mid="M"), rel("localMethods", 0, 0, 1)], {"IdentifierIntegrity": 1, "AbstractionPolicy": 2}),
    "two owners": ([*cls("A", "B"), met(0), rel("localMethods", 0, 0), rel("localMethods", 1, 0)], {"ExclusiveDeclarationOwnership": 1, "AbstractionPolicy": 2}),
    "cycle": ([*cls("A"), rel("parents", 0, 0)], {"AcyclicGeneralization": 1}),
    "private inherited": ([*cls("A", "B"), met(0, inheritable="No"), rel("localMethods", 1, 0), rel("parents", 0, 1), rel("inheritedMethods", 0, 0)], {"InheritedMemberDerivation": 1, "AbstractionPolicy": 2}),
    "overlap": ([*cls("A", "B"), met(0), rel("localMethods", 0, 0), rel("localMethods", 1, 0), rel("parents", 0, 1), rel("inheritedMethods", 0, 0)], {"ExclusiveDeclarationOwnership": 1, "LocalInheritedSeparation": 1, "AbstractionPolicy": 2}),
    "abstract with body": ([*cls("A"), met(0, abstract="Yes"), rel("localMethods", 0, 0), *bind(0, 0, 0)], {"ImplementationBindingPolicy": 1, "AbstractionPolicy": 1}),
    "orphan body": ([*cls("A"), met(0), rel("localMethods", 0, 0), *bind(0, 0, 0), "MethodBody1 = { }"], {"ImplementationBindingPolicy": 1}),
    "no binding at all": ([*cls("A"), met(0), rel("localMethods", 0, 0)], {"AbstractionPolicy": 1}),
    "one binding of two": ([*cls("A"), met(0), met(1, "n"), rel("localMethods", 0, 0, 1), *bind(0, 0, 0)], {"ImplementationBindingPolicy": 1, "AbstractionPolicy": 1}),
    "bound by the heir": ([*cls("A", "B"), met(0), rel("localMethods", 1, 0), rel("parents", 0, 1), rel("inheritedMethods", 0, 0), *bind(0, 0, 0)], {"ImplementationBindingPolicy": 1, "AbstractionPolicy": 1}),
    "abstract in concrete": ([*cls("A"), met(0, abstract="Yes"), rel("localMethods", 0, 0)], {"AbstractionPolicy": 1}),
    "static abstract": ([*cls("A"), met(0, scope="Static", abstract="Yes"), rel("localMethods", 0, 0)], {"AbstractionPolicy": 1, "StaticMethodPolicy": 1}),
    "namespace": ([*cls("A"), met(0), met(1), rel("localMethods", 0, 0, 1)], {"AbstractionPolicy": 2, "LocalMethodNamespace": 1}),
    "conflict": ([*cls("A", "B", "C"), met(0), met(1), rel("localMethods", 1, 0), rel("localMethods", 2, 1), rel("parents", 0, 1), rel("parents", 0, 2), rel("inheritedMethods", 0, 0, 1)], {"AbstractionPolicy": 4, "InheritedConflictPolicy": 1}),
    "override": ([*cls("A", "B"), met(0), met(1, kind="int"), rel("localMethods", 1, 0), rel("localMethods", 0, 1), rel("parents", 0, 1), rel("inheritedMethods", 0, 0)], {"AbstractionPolicy": 3, "OverridePolicy": 1}),
    "covariant override": ([*cls("A", "B"), met(0, kind="B"), met(1, kind="A"), rel("localMethods", 1, 0), rel("localMethods", 0, 1), rel("parents", 0, 1), rel("inheritedMethods", 0, 0)], {"AbstractionPolicy": 3}),
    "other scope": ([*cls("A", "B"), met(0), met(1, kind="int", scope="Static"), rel("localMethods", 1, 0), rel("localMethods", 0, 1), rel("parents", 0, 1), rel("inheritedMethods", 0, 0)], {"AbstractionPolicy": 3}),
}


def test_outcomes_of_the_checker(spark):
    texts = [(name, "\n".join(["Root = {", "  classifiers = {}", "", *lines, "}"])) for name, (lines, _) in CASES.items()]
    texts += [("garbage", "no model"), ("empty", instance_text.EMPTY)]
    given = spark.createDataFrame(texts, "repo string, value string")
    m = instance_text.to_instance(instance_text.lines(given))
    found = rules.violations(m, rules.names_of("checker")).select("repo", "invariant", "description")
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["repo"], {}).setdefault(r["invariant"], []).append(r["description"])
    assert {k: {i: len(d) for i, d in v.items()} for k, v in got.items()} == {k: v for k, (_, v) in CASES.items() if v}
    assert got["class id"]["IdentifierIntegrity"] == ["Duplicate ClassifierID A on Classifier0 and Classifier1"]
    assert sorted(got["bound by the heir"]["AbstractionPolicy"]) == ["Non-abstract classifier Classifier1 has non-abstract method Method0 with no ImplementationBinding visible in ancestor chain"]
    assert got["no binding at all"]["AbstractionPolicy"] == ["Non-abstract classifier Classifier0 has non-abstract method Method0 without any ImplementationBinding"]
    shown = spark.createDataFrame([(k, i, d) for k, v in got.items() for i, ds in v.items() for d in ds], "repo string, invariant string, description string")
    failed = spark.createDataFrame([("cycle", "stopped")], "repo string, description string")
    reports = {r["repo"]: json.loads(r["value"]) for r in sinks.report_json(shown, given, failed).collect()}
    assert reports["garbage"] == {"result": "SAT", "violations": []} and reports["cycle"] == {"result": "ERROR", "violations": [{"description": "stopped"}]}
    assert reports["two owners"]["result"] == "UNSAT" and len(reports["two owners"]["violations"]) == 3
    verdict = {r["repo"]: r["result"] for r in rules.verdicts(shown, given, failed).collect()}
    assert verdict["empty"] == "SAT" and verdict["cycle"] == "ERROR" and verdict["override"] == "UNSAT"


def test_instance_text_of_documents(spark):
    doc = '{"types":[{"qualifiedName":"a.B","executables":[{"name":"B","constructor":true},{"name":"say \\"x\\"","parameters":[{"type":"int"}]},{"name":"no","abstractExecutable":true}]},{"qualifiedName":"a.C","superClass":"a.B","fields":[{"name":"f"}]}]}'
    made = {r["repo"]: r["value"] for r in instance_text.from_documents(spark.createDataFrame([("r", doc), ("e", '{"types":[]}')], "repo string, value string")).collect()}
    lines = made["r"].splitlines()
    assert made["e"] == instance_text.EMPTY and lines[3:5] == ["Root = {", "  classifiers = {Classifier0, Classifier1}"]
    assert 'Method1 = { mid = "Method1", memberName = "say \\"x\\"", returnType = "void", paramTypes = "int", isInheritable = Yes, scope = Instance, isAbstract = No }' in lines
    assert lines[lines.index("localMethods[Classifier0] = { Method1, Method2 }") + 1].startswith("Attribute0 = {") and "parents[Classifier1] = { Classifier0 }" in lines
    assert lines[-3:] == ["  bodies = {MethodBody0}", "  bindings = {ImplementationBinding0}", "}"] and "target[ImplementationBinding0] = { Method1 }" in lines


def test_files_lists_and_pages(spark, tmp_path):
    for name, data in (("r1/a.py", b"class A: pass"), ("r1/sub/b.py", b"\xff\xfe"), ("r2/c.txt", b"x")):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = python_source.files(spark, str(tmp_path / "src"))
    assert sorted(map(tuple, found.collect())) == [("r1", "a.py", "class A: pass"), ("r1", "sub/b.py", None)]
    assert [r["qualifiedName"] for r in python_source.extract(found).collect()] == ["A"]
    paths = spark.createDataFrame([("r", "a/src/main/java/X.java"), ("r", "a/src/main/java/y/src/main/java/Z.java"), ("s", "target/src/main/java/X.java"), ("s", "src/test/java/T.java")], "repo string, path string")
    assert sorted(map(tuple, listing.source_roots(paths).collect())) == [("r", "a/src/main/java"), ("s", "")]
    assert [r[0] for r in listing.addresses(spark.createDataFrame([("# no",), ("",), (" u ",), (None,)], "value string")).collect()] == ["u"]
    for name in ("one/extraction.json", "one/report.json", "two/extraction.json"):
        p = tmp_path / "out" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}")
    assert sorted(map(tuple, listing.existing_outputs(spark, str(tmp_path / "out")).collect())) == [("one", True, True), ("two", True, False)]
    cpp = spark.createDataFrame([("src/a.HPP",), ("vendor/b.cpp",), ("c.py",), ("h",)], "path string")
    assert [r[0] for r in other_languages.cpp_files(cpp).collect()] == ["src/a.HPP"]
    with pytest.raises(NotImplementedError):
        other_languages.extract(paths, None)
    files = spark.createDataFrame([("r", "A.java", "A B")], "repo string, path string, content string")
    assert [(r["pos"], r["qualifiedName"]) for r in other_languages.extract(files, lambda t: [{"qualifiedName": w} for w in t.split()]).collect()] == [(0, "A"), (1, "B")]
    for i in range(3):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"total_count": 5, "items": [{"id": 2 * i + j, "name": f"n{2 * i + j}", "license": {"spdx_id": "MIT"} if j else None} for j in range(2) if 2 * i + j < 5]}))
    spark.dataSource.register(catalog_pages.CatalogPages)
    rows = spark.read.format("catalog_pages").option("size", 2).option("limit", 4).load(f"file://{tmp_path}/page{{page}}.json").collect()
    assert [(r["id"], r["license"], r["stars"], r["fork"]) for r in sorted(rows)] == [(0, "", 0, False), (1, "MIT", 0, False), (2, "", 0, False), (3, "MIT", 0, False)]


def test_sinks_and_numbers(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', None), ("x\ny", "z")], "p string, q string")
    assert [r[0] for r in sinks.csv_lines(rows).collect()] == ['"a,""b""",', '"x\ny",z']
    sinks.write_csv(rows.limit(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()[0]["p"] == 'a,"b"'
    sinks.write_reports(spark.createDataFrame([("r", "{}")], "repo string, value string"), str(tmp_path / "reports"))
    sinks.write_reports(spark.createDataFrame([("r", "other")], "repo string, value string"), str(tmp_path / "reports"), "ignore")
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "reports")).select("repo", "value").collect()] == [("r", "{}")]
    n = spark.sql("SELECT 3 AS done, 8 AS total, -2 AS low, 41 AS n, '2024-02-30' AS bad, '2024-02-29' AS good, '2024-01-31T10:00:00Z' AS at")
    c = F.col
    assert tuple(n.select(numbers.percent(c("done"), c("total")), numbers.at_least_zero(c("low")), numbers.page_count(c("n"), 20), numbers.day(c("bad")), F.date_format(numbers.day(c("good")), "d"), F.unix_seconds(numbers.instant(c("at")))).collect()[0]) == (38, 0, 3, None, "29", 1706695200)
    with pytest.raises(ValueError):
        extraction.Options(compliance=7)
    with pytest.raises(ValueError):
        catalog.Criteria(language="x", fork="SOME")
    assert catalog.license_names("mit OR apache-2.0, bsd") == ("mit", "apache-2.0", "bsd")
