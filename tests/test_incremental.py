"""Keys, incremental runs and the lookup of names in specification lines, on small fixtures."""

import glob
import os

from pyspark.sql import functions as F

from structcheck.operators import cache, rules, spec_lines
from structcheck.sources import instance_text

FILES = "repo string, path string, content string"


def keys(spark, rows):
    return {r["repo"]: r["extraction_key"] for r in cache.extraction_keys(spark.createDataFrame(rows, FILES)).collect()}


def test_keys_differ_with_paths_contents_and_options_alone(spark):
    base = [("a", "src/A.java", "class A {}"), ("a", "src/B.java", None), ("b", "src/A.java", "class A {}")]
    k = keys(spark, base)
    assert keys(spark, base[::-1] + [("a", "build/C.java", "x"), ("a", "README.md", "y"), ("a", "x/.git/D.java", "z")]) == k
    assert keys(spark, [("a", "src/A.java", "class A {}"), ("a", "src/B.java", "")])["a"] == k["a"]
    for other in ([("a", "src/A.java", "class A { }"), base[1]], [("a", "src/X.java", "class A {}"), base[1]], base[:1]):
        assert keys(spark, other)["a"] != k["a"]
    df = spark.createDataFrame(base, FILES)
    some = {cache.extraction_keys(df, *args).filter("repo = 'a'").first()["extraction_key"] for args in (("",), ("r1",), ("", 21), ("", 17, True))}
    assert len(some) == 4
    assert cache.extraction_keys(df.limit(0)).collect() == []


def test_stored_keys(spark, tmp_path):
    path = f"file://{tmp_path}/keys"
    assert cache.load(spark, path).collect() == []
    cache.save(cache.with_extractions(cache.load(spark, path), spark.createDataFrame([("a", "1", 5), ("b", "2", 6)], "repo string, extraction_key string, types int")), path)
    cache.save(cache.with_verifications(cache.load(spark, path), spark.createDataFrame([("a", "v"), ("z", "v")], "repo string, verification_key string")), path)
    assert sorted(tuple(r) for r in cache.load(spark, path).collect()) == [("a", "1", 5, "v"), ("b", "2", 6, None)]
    cache.save(cache.with_extractions(cache.load(spark, path), spark.createDataFrame([("a", "3", 7)], "repo string, extraction_key string, types int")), path)
    assert sorted(tuple(r) for r in cache.load(spark, path).collect()) == [("a", "3", 7, None), ("b", "2", 6, None)]  # a new extraction ends its verification
    os.makedirs(f"{tmp_path}/keys/v=9")  # a version that was not written whole
    assert cache.load(spark, path).count() == 2
    assert len(glob.glob(f"{tmp_path}/keys/v=*/_SUCCESS")) == 2


def test_states(spark):
    stored = spark.createDataFrame([("same", "1", 1, "v"), ("edited", "1", 1, "v"), ("unchecked", "1", 1, None), ("gone", "1", 1, "v"), ("lost", "1", 1, "v")], cache.KEYS)
    current = spark.createDataFrame([("same", "1", "v"), ("edited", "2", "w"), ("unchecked", "1", "v"), ("new", "1", "v"), ("lost", "1", "v")], "repo string, extraction_key string, verification_key string")
    outputs = spark.createDataFrame([(r, True, r != "lost") for r in ("same", "edited", "unchecked", "gone", "lost")], "repo string, extracted boolean, reported boolean")
    got = {r["repo"]: (r["extraction"], r["verification"]) for r in cache.diff(stored, current, outputs).collect()}
    assert got == {"same": ("same", "same"), "edited": ("changed", "changed"), "unchecked": ("same", "changed"), "gone": ("removed", "removed"), "new": ("added", "added"), "lost": ("same", "changed")}


def test_only_what_changed_is_checked_and_rewritten(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/out", []
    cls = lambda *names: "\n".join(["Root = {", "  classifiers = {}", "", *[f'Classifier{i} = {{ cid = "{i}", name = "{n}", isAbstract = No }}' for i, n in enumerate(names)], "}"])

    def run(texts):
        m = instance_text.to_instance(instance_text.lines(spark.createDataFrame(list(texts.items()), "repo string, value string")))
        current = spark.createDataFrame([(r, t, f"v{t}", 1) for r, t in texts.items()], "repo string, extraction_key string, verification_key string, types int")

        def check(repos):
            asked.append(sorted(r[0] for r in repos.collect()))
            return rules.violations(rules.restricted(m, repos), ["chk_duplicate_names"])

        changes = {r["repo"]: r["verification"] for r in cache.refresh(folder, current, check, buckets=8).collect()}
        rows = sorted((r["repo"], r["subject"]) for r in cache.reports(spark, folder).collect())
        return changes, rows, {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/out/reports/bucket=*/*.parquet")}

    texts = {f"r{i}": cls("A", "A", f"B{i}") for i in range(12)} | {"fine": cls("A", "B")}
    changes, rows, first = run(texts)
    assert set(changes.values()) == {"added"} and rows == sorted((f"r{i}", "A") for i in range(12))
    changes, rows, second = run(texts)
    assert set(changes.values()) == {"same"} and asked[-1] == [] and second == first
    changes, rows, third = run(texts | {"r3": cls("A", "B", "B")})
    assert [r for r, s in changes.items() if s != "same"] == ["r3"] == asked[-1] and ("r3", "B") in rows and ("r3", "A") not in rows and len(rows) == 12
    kept = lambda a, b: {os.path.dirname(f) for f in a if b.get(f) == a[f]}
    assert len({os.path.dirname(f) for f in second}) - len(kept(second, third)) == 1  # one partition is rewritten
    changes, rows, _ = run({"r3": texts["r3"], "late": cls("C", "C")})
    assert changes["late"] == "added" and changes["r5"] == "removed" and rows == [("late", "C"), ("r3", "A")]


def test_names_from_the_lines_of_a_specification(spark):
    lines = spark.createDataFrame([("s", i, "  invariant First :" if i == 3 else "invariant Second: x" if i == 20 else "invariant 9bad:" if i == 8 else None if i == 5 else "text") for i in range(1, 41)] + [("t", 1, "no")], "spec string, line int, text string")
    given = [(i, "s", i, None, 7) for i in (0, 1, 2, 3, 4, 13, 14, 19, 20, 30, 31, 40, 41)] + [(90, "s", 20, "Own", 7), (91, "s", None, None, 7), (92, "t", 1, None, 7), (93, None, 3, None, 7), (94, "s", 20, None, 7)]
    out = {r["id"]: r["invariant"] for r in spec_lines.named(spark.createDataFrame(given, "id int, spec string, line int, invariant string, FOUND int"), lines).collect()}
    first, second = dict.fromkeys((3, 4, 13), "First"), dict.fromkeys((20, 30, 94), "Second")
    assert out == dict.fromkeys((0, 1, 2, 14, 19, 31, 40, 41, 91, 92, 93)) | first | second | {90: "Own"}
    assert spec_lines.named(spark.createDataFrame(given[:1], "id int, spec string, line int, invariant string, FOUND int"), lines.limit(0)).first()["invariant"] is None


def test_lines_are_read_from_files(spark, tmp_path):
    (tmp_path / "rules.recore").write_text("model\r\ninvariant One:\nend")
    assert [tuple(r) for r in spec_lines.read_lines(spark, f"file://{tmp_path}/rules.recore").orderBy("line").collect()] == [("rules", 1, "model"), ("rules", 2, "invariant One:"), ("rules", 3, "end")]


def test_nulls_and_swapped_parameters(spark):
    """What the checker passes over, and its key of sorted parameter types."""
    schema = "repo string, method string, ord int, mid string, member_name string, return_type string, param_types string, is_inheritable string, scope string, is_abstract string"
    methods = [("r", f"M{i}", i, None, n, "void", p, "Yes", "Instance", "Yes") for i, (n, p) in enumerate([("f", "A, B"), ("f", "B, A"), (None, "A"), (None, "A"), ("g", None), ("g", None), ("h", '{a = "X"}'), ("h", "X")])]
    tuples = spark.createDataFrame([("r", "C0", f"M{i}") for i in range(8)], "repo string, cls string, method string")
    none = lambda schema: spark.createDataFrame([], schema)
    attributes = spark.createDataFrame([("r", "A0", 0, None, None, "t", "Yes", "Instance"), ("r", "A1", 1, None, None, "t", "Yes", "Instance")], "repo string, attribute string, ord int, aid string, member_name string, type string, is_inheritable string, scope string")
    m = rules.Instance(
        classifier=spark.createDataFrame([("r", f"C{i}", i, None, None, "Yes") for i in range(2)], "repo string, cls string, ord int, cid string, name string, is_abstract string"),
        method=spark.createDataFrame(methods, schema), attribute=attributes, body=none("repo string, body string"),
        binding=spark.createDataFrame([("r", "B0", "C0", None, None), ("r", "B1", "C0", None, None), ("r", "B2", None, "M0", None)], "repo string, binding string, implementer string, target string, body string"),
        parents=none("repo string, cls string, parent string, ord int"), local_methods=tuples, local_attributes=none("repo string, cls string, attribute string"),
        inherited_methods=tuples, inherited_attributes=spark.createDataFrame([("r", "C1", "A0"), ("r", "C1", "A1")], "repo string, cls string, attribute string"),
    )

    def of(name):
        return sorted(r["description"] for r in rules.REGISTRY[name].check(m).collect())

    for name in ("chk_duplicate_names", "chk_binding_target", "chk_multiple_bindings", "chk_inherited_attr_conflict"):
        assert of(name) == []
    keys = ["'f(A,B)' in C0: [M0, M1]", "'g' in C0: [M4, M5]", "'h(X)' in C0: [M6, M7]"]
    assert of("chk_local_namespace") == [f"Duplicate method key {k}" for k in keys]
    assert of("chk_inherited_method_conflict") == [f"Inherited method conflict key {k}" for k in keys]
    assert of("spec_local_namespace") == of("spec_inherited_method_conflict") == []
    assert {r["description"] for r in rules.violations(m, rules.names_of()).filter(F.col("description").isNull()).collect()} == set()
