"""Documents of both shapes, with flags quoted or not, give equal atoms."""

import json

from structcheck.sources import extraction

METHOD = {"name": "speak", "returnType": "void", "visibility": "PRIVATE", "parameters": [{"name": "x", "type": "int"}]}
PRESENT = {
    "schemaVersion": "1.0",
    "types": [
        {"qualifiedName": "p.Animal", "superClass": None, "abstractType": "true", "fields": [{"name": "f", "type": "String", "visibility": "private", "staticField": True}], "executables": [METHOD | {"staticExecutable": False, "abstractExecutable": "true"}, {"name": "<init>", "constructor": True, "parameters": []}]},
        {"qualifiedName": "p.Dog", "superClass": "p.Animal", "abstractType": False, "fields": [], "executables": [METHOD | {"staticExecutable": "TRUE", "abstractExecutable": False}]},
        {"qualifiedName": "Lone", "interfaces": ["p.I"]},
    ],
}
OLDER = {
    "projectName": "x", "includeTests": False,
    "types": [
        {"name": "Animal", "package": "p", "superclass": "java.lang.Object", "abstract": True, "sourcePosition": "A.java:1", "fields": [{"name": "f", "type": "String", "visibility": "private", "static": "true"}], "methods": [METHOD | {"static": False, "abstract": True}, {"name": "<init>", "constructor": "true", "parameters": []}]},
        {"name": "Dog", "package": "p", "superclass": "p.Animal", "abstract": "false", "fields": [], "methods": [METHOD | {"static": True, "abstract": "false"}]},
        {"name": "Lone", "package": "", "interfaces": ["p.I"]},
    ],
}


def atoms(types):
    made = [extraction.classifiers(types), extraction.methods(types), extraction.attributes(types), extraction.bindings(types), extraction.parents(types), extraction.local_methods(types)]
    out = {}
    for i, df in enumerate(made):
        for r in df.collect():
            out.setdefault(r["repo"], []).append((i, *map(str, tuple(r)[1:])))
    return {k: sorted(v) for k, v in out.items()}


def test_both_shapes_give_equal_atoms(spark):
    given = [("present", json.dumps(PRESENT)), ("older", json.dumps(OLDER)), ("text", "no json"), ("null", None), ("empty", '{"types": []}'), ("none", "{}"), ("list", "[1]"), ("wrong", '{"types": [1, {"name": 3}]}')]
    docs = spark.createDataFrame(given, "repo string, value string")
    got = atoms(extraction.load_types(docs, either=True))
    assert got["present"] == got["older"] == atoms(extraction.load_types(docs.filter("repo = 'present'")))["present"]
    assert set(got) <= {"present", "older", "wrong"}
    either = extraction.any_shape(docs.filter("repo = 'older'")).selectExpr("d.types[0] AS t").first()["t"]
    assert (either["sourceFile"], either["superClass"], either["simpleName"]) == ("A.java", None, "Animal")
