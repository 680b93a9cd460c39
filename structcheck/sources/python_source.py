"""Types of Python source files, read from their syntax trees in the tasks that hold the files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structcheck.functions.tables import dealt

#: Base classes that make a class an interface, and those that are no superclass.
INTERFACES = frozenset({"ABC", "ABCMeta", "Protocol"})
PLAIN_BASES = frozenset({"object", "ABC", "ABCMeta", "Protocol", "Exception", "BaseException"})

MEMBERS = (
    "fields array<struct<name:string,type:string,visibility:string,staticField:boolean,finalField:boolean,line:int>>, "
    "executables array<struct<name:string,returnType:string,visibility:string,constructor:boolean,staticExecutable:boolean,"
    "abstractExecutable:boolean,parameters:array<struct<name:string,type:string>>,line:int>>"
)
SCHEMA = (
    "repo string, path string, pos int, qualifiedName string, simpleName string, kind string, superClass string, "
    f"interfaces array<string>, {MEMBERS}, abstractType boolean, finalType boolean, line int"
)


def _last_name(node: ast.expr | None) -> str | None:
    """The name, or the last part of a dotted one; None for any other expression."""
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _decorated(node: ast.AST, *names: str) -> bool:
    return any(_last_name(d) in names for d in getattr(node, "decorator_list", ()))


def _visibility(name: str) -> str:
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def _assigned_visibility(name: str) -> str:
    """As `_visibility`, but a single underscore with a double one after it leaves a plain assignment public."""
    return "public" if name.startswith("_") and "__" in name and not name.startswith("__") else _visibility(name)


def _returned(node: ast.expr | None) -> str:
    if node is None or isinstance(node, ast.Constant):
        return "None"
    return node.id if isinstance(node, ast.Name) else "unknown"


def _executable(f: ast.FunctionDef) -> dict:
    given = [a for a in f.args.args if a.arg not in ("self", "cls")]
    return {
        "name": f.name, "returnType": _returned(f.returns), "visibility": _visibility(f.name), "constructor": f.name == "__init__",
        "staticExecutable": _decorated(f, "staticmethod", "classmethod"), "abstractExecutable": _decorated(f, "abstractmethod"),
        "parameters": [{"name": a.arg, "type": _last_name(a.annotation) or "unknown"} for a in given], "line": f.lineno,
    }


def _fields(body: list[ast.stmt]) -> Iterator[dict]:
    for s in body:
        if isinstance(s, ast.Assign):
            found = [(t.id, "unknown", _assigned_visibility(t.id)) for t in s.targets if isinstance(t, ast.Name)]
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            found = [(s.target.id, _last_name(s.annotation) or "unknown", _visibility(s.target.id))]
        else:
            continue
        for name, kind, visibility in found:
            yield {"name": name, "type": kind, "visibility": visibility, "staticField": False, "finalField": False, "line": s.lineno}


def _class(c: ast.ClassDef, within: tuple[str, ...]) -> dict:
    bases = [_last_name(b) or "" for b in c.bases]
    real = [b for b in bases if b not in PLAIN_BASES]
    functions = [f for f in c.body if isinstance(f, ast.FunctionDef)]
    meta = any(k.arg == "metaclass" and _last_name(k.value) == "ABCMeta" for k in c.keywords)
    return {
        "qualifiedName": ".".join((*within, c.name)), "simpleName": c.name, "kind": "interface" if meta or INTERFACES & set(bases) else "class",
        "superClass": real[0] if real else None, "interfaces": real[1:], "fields": list(_fields(c.body)), "executables": [_executable(f) for f in functions],
        "abstractType": any(_decorated(f, "abstractmethod") for f in (c, *functions)), "finalType": False, "line": c.lineno,
    }


def types_of(source: str) -> list[dict]:
    """The classes of a module, an outer one before those within it; none for source that is no Python."""
    try:
        tree = ast.parse(source.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def visit(node: ast.AST, within: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.append(_class(child, within))
                visit(child, (*within, child.name))
            else:
                visit(child, within)

    visit(tree, ())
    return out


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The Python files below `folder` as (repo, path, content): repo is the first folder below it, path the rest.

    A file that is not UTF-8 has a null content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(folder)
    below = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*" + folder.split(":", 1)[-1].strip("/").replace(".", r"\.") + r"/+([^/]+)/(.+)$", 1)
    rest = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*" + folder.split(":", 1)[-1].strip("/").replace(".", r"\.") + r"/+([^/]+)/(.+)$", 2)
    return found.select(below.alias("repo"), rest.alias("path"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))


def extract(files: DataFrame) -> DataFrame:
    """`files` (repo, path, content): a row of SCHEMA for each class; `pos` counts them in their file."""

    def run(batches):
        import pandas as pd

        names = [x.split(" ")[0] for x in "repo path pos qualifiedName simpleName kind superClass interfaces fields executables abstractType finalType line".split()]
        for b in batches:
            rows = [{"repo": r, "path": p, "pos": i, **t} for r, p, c in b.itertuples(index=False) for i, t in enumerate(types_of(c or ""))]
            yield pd.DataFrame(rows, columns=names)

    return dealt(files.select("repo", "path", "content"), "repo", "path").mapInPandas(run, SCHEMA)


def first_of_name(types: DataFrame) -> DataFrame:
    """Of types of one qualified name in a repository, the first by path and place."""
    place = F.struct("path", "pos")
    columns = [c for c in types.columns if c not in ("repo", "qualifiedName")]
    first = types.groupBy("repo", "qualifiedName").agg(F.min_by(F.struct(*columns), place).alias("t"))
    return first.select("repo", "qualifiedName", "t.*").select(*types.columns)
