"""Extraction documents: nested JSON of a repository's types, and the flat relations mapped from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structcheck.functions.arrays import length, let, running
from structcheck.functions.tables import written
from structcheck.functions.text import identifier, param_signature, truth, yes_no

#: Flags are read as strings, since a document may quote them.
FIELD = "struct<name:string,type:string,visibility:string,staticField:string,finalField:string>"
PARAMETER = "struct<name:string,type:string>"
EXECUTABLE = (
    "struct<name:string,returnType:string,visibility:string,constructor:string,staticExecutable:string,"
    f"abstractExecutable:string,parameters:array<{PARAMETER}>>"
)
TYPE = (
    "struct<qualifiedName:string,simpleName:string,kind:string,superClass:string,interfaces:array<string>,"
    f"fields:array<{FIELD}>,executables:array<{EXECUTABLE}>,abstractType:string,finalType:string,sourceFile:string>"
)
SCHEMA = f"schemaVersion string, projectName string, repository string, types array<{TYPE}>"


@dataclass(frozen=True)
class Options:
    """What an extraction is asked for; a ValueError says what is not allowed."""

    compliance: int = 17
    depth: int = 1
    include_tests: bool = False

    def __post_init__(self) -> None:
        if not 8 <= self.compliance <= 23:
            raise ValueError("a compliance level is from 8 to 23")
        if self.depth < 1:
            raise ValueError("a clone depth is 1 at least")


def _concrete(e: Column) -> Column:
    """Whether an executable gets a body: no constructor, not abstract."""
    return ~truth(e["constructor"]) & ~truth(e["abstractExecutable"])


def keys(documents: DataFrame) -> list[str]:
    """repo, and part where documents come in several values: each part is a document of some of the types, in order."""
    return [c for c in ("repo", "part") if c in documents.columns]


def _parsed(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(*keys(documents), *more, F.from_json("value", SCHEMA).alias("d"))


#: The older names of members, and a superclass that is none.
OLDER = {"superClass": "superclass", "abstractType": "abstract", "finalType": "final", "executables": "methods", "staticField": "static", "finalField": "final", "staticExecutable": "static", "abstractExecutable": "abstract"}
NO_SUPERCLASS = "java.lang.Object"


def _member(v: Column, name: str, kind: str = "string") -> Column:
    """A member of an object by its name, or by its older one; null where it is missing or of another kind."""
    found = F.try_variant_get(v, f"$.{name}", kind)
    return F.coalesce(found, F.try_variant_get(v, f"$.{OLDER[name]}", kind)) if name in OLDER else found


def _listed(v: Column, name: str, body) -> Column:
    return F.transform(_member(v, name, "array<variant>"), body)


def any_shape(documents: DataFrame, *more: str) -> DataFrame:
    """`documents` (repo, value) of either shape, in the present one: (repo, d), d.types an array of TYPE.

    Documents are read as variants, so one reader takes both: an older one names a type by ``name`` and ``package``, its
    superclass, flags and methods by other members, and says ``java.lang.Object`` where there is no superclass. Flags may
    be quoted. A source file is the position up to its colon. What is no JSON has no types.
    """
    def field(f: Column) -> Column:
        return F.struct(*[_member(f, n).alias(n) for n in ("name", "type", "visibility", "staticField", "finalField")])

    def executable(e: Column) -> Column:
        names = ("name", "returnType", "visibility", "constructor", "staticExecutable", "abstractExecutable")
        return F.struct(*[_member(e, n).alias(n) for n in names], _listed(e, "parameters", lambda p: F.struct(_member(p, "name").alias("name"), _member(p, "type").alias("type"))).alias("parameters"))

    def type_(t: Column) -> Column:
        older = F.concat_ws(".", F.nullif(_member(t, "package"), F.lit("")), _member(t, "name"))
        return F.struct(
            F.coalesce(_member(t, "qualifiedName"), F.nullif(older, F.lit(""))).alias("qualifiedName"), F.coalesce(_member(t, "simpleName"), _member(t, "name")).alias("simpleName"), _member(t, "kind").alias("kind"),
            F.nullif(_member(t, "superClass"), F.lit(NO_SUPERCLASS)).alias("superClass"), _member(t, "interfaces", "array<string>").alias("interfaces"), _listed(t, "fields", field).alias("fields"), _listed(t, "executables", executable).alias("executables"),
            _member(t, "abstractType").alias("abstractType"), _member(t, "finalType").alias("finalType"), F.coalesce(_member(t, "sourceFile"), F.substring_index(_member(t, "sourcePosition"), ":", 1)).alias("sourceFile"),
        )

    parsed = documents.select(*keys(documents), *more, F.try_parse_json("value").alias("v"))
    whole = F.struct(_member(F.col("v"), "schemaVersion").alias("schemaVersion"), _listed(F.col("v"), "types", type_).alias("types"))
    return parsed.select(*keys(documents), *more, whole.cast(f"struct<schemaVersion:string,types:array<{TYPE}>>").alias("d"))


def _counts(types: Column) -> list[Column]:
    """The numbers of executables, fields and executables with a body of each type."""
    return [
        F.transform(types, lambda t: length(t["executables"])), F.transform(types, lambda t: length(t["fields"])),
        F.transform(types, lambda t: length(F.filter(t["executables"], _concrete))),
    ]


def _before(rows: DataFrame) -> DataFrame:
    """(repo, part, before): the numbers of types and members in the parts before each, from the last numbers in each part;
    the window has a row for a part."""
    n = rows.groupBy("repo", "part").agg((F.max("tpos") + 1).cast("bigint").alias("t"), *[F.max(f"x.to.{n}").alias(n) for n in "efb"])
    earlier = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("repo", "part", F.struct(*[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in "tefb"]).alias("before"))


def load_types(documents: DataFrame, either: bool = False) -> DataFrame:
    """`documents` (repo, value): repo, tpos, the numbers of members before the type in its document, and its fields.
    With `either`, documents may have the older shape as well, see `any_shape`.

    The numbers are method_base (executables), field_base and body_base (executables with a body); they are summed within
    the document. A document that is no JSON or has no types gives none. A document too large for one value comes in
    parts (repo, part, value), numbered in order: places and numbers go on from part to part, and a task holds a part.
    Parts are read once, when this is called, and written as a row for each type; a row for each part is broadcast.
    """
    def numbered(types: Column) -> Column:
        counts = _counts(types)
        sums = F.struct(*[running(c, lambda x, y: x + y).alias(n) for c, n in zip(counts, "efb")], *[c.alias(f"n{n}") for c, n in zip(counts, "efb")])

        def row(s: Column) -> Column:
            before = lambda n, i: F.get(s[n], i) - F.get(s[f"n{n}"], i)
            return F.transform(types, lambda t, i: F.struct(t.alias("t"), before("e", i).alias("e"), before("f", i).alias("f"), before("b", i).alias("b"), F.struct(*[F.get(s[n], i).alias(n) for n in "efb"]).alias("to")))

        return let(sums, row)

    shape, parts = any_shape if either else _parsed, "part" in documents.columns
    rows = shape(documents).select(*keys(documents), F.posexplode(let(F.col("d.types"), numbered)).alias("tpos", "x"))
    if parts:
        rows = written(rows, "types")
        rows = rows.join(F.broadcast(_before(rows)), ["repo", "part"]).withColumn("tpos", F.coalesce("tpos", F.lit(0)))
    at = lambda c, n: (c + F.col(f"before.{n}") if parts else c)
    return rows.select("repo", at(F.col("tpos"), "t").cast("int").alias("tpos"), at(F.col("x.e"), "e").alias("method_base"), at(F.col("x.f"), "f").alias("field_base"), at(F.col("x.b"), "b").alias("body_base"), "x.t.*")


def type_count(documents: DataFrame) -> DataFrame:
    """Types of each document: (repo, n_types), 0 for one without any."""
    each = _parsed(documents).select("repo", length(F.col("d.types")).cast("long").alias("n_types"))
    return each.groupBy("repo").agg(F.sum("n_types").alias("n_types")) if "part" in documents.columns else each


def _atom(prefix: str, number: Column | str) -> Column:
    return F.concat(F.lit(prefix), number)


def classifiers(types: DataFrame) -> DataFrame:
    return types.select(
        "repo", _atom("Classifier", "tpos").alias("cls"), "tpos", identifier(F.col("qualifiedName")).alias("cid"),
        F.col("qualifiedName").alias("name"), yes_no(truth(F.col("abstractType"))).alias("is_abstract"),
    )


def parents(types: DataFrame) -> DataFrame:
    """An edge for each type whose superclass is a type of the document; of types of one name the last counts."""
    last = types.groupBy("repo", "qualifiedName").agg(F.max("tpos").alias("ppos"))
    last = last.select("repo", F.col("qualifiedName").alias("superClass"), "ppos")
    return types.join(last, ["repo", "superClass"]).select("repo", _atom("Classifier", "tpos").alias("src"), _atom("Classifier", "ppos").alias("dst"))


def _inheritable(visibility: Column) -> Column:
    return yes_no(~F.coalesce(F.lower(visibility) == "private", F.lit(False)))


def _static(flag: Column) -> Column:
    return F.when(truth(flag), "Static").otherwise("Instance")


def methods(types: DataFrame) -> DataFrame:
    """Method atoms. Constructors count in the numbering and give no atom."""
    rows = types.select("repo", "tpos", "method_base", F.posexplode("executables").alias("epos", "e")).filter(~truth(F.col("e.constructor")))
    number = F.col("method_base") + F.col("epos")
    return rows.select(
        "repo", _atom("Classifier", "tpos").alias("cls"), _atom("Method", number).alias("method"), "tpos", "epos",
        F.col("e.name").alias("member_name"), F.coalesce("e.returnType", F.lit("void")).alias("return_type"),
        param_signature(F.transform("e.parameters", lambda p: p["type"])).alias("param_types"),
        _inheritable(F.col("e.visibility")).alias("is_inheritable"), _static(F.col("e.staticExecutable")).alias("scope"),
        yes_no(truth(F.col("e.abstractExecutable"))).alias("is_abstract"),
    )


def attributes(types: DataFrame) -> DataFrame:
    rows = types.select("repo", "tpos", "field_base", F.posexplode("fields").alias("fpos", "f"))
    return rows.select(
        "repo", _atom("Classifier", "tpos").alias("cls"), _atom("Attribute", F.col("field_base") + F.col("fpos")).alias("attribute"),
        F.col("f.name").alias("member_name"), F.coalesce("f.type", F.lit("Object")).alias("type"),
        _inheritable(F.col("f.visibility")).alias("is_inheritable"), _static(F.col("f.staticField")).alias("scope"),
    )


def bindings(types: DataFrame) -> DataFrame:
    """A body and a binding for each executable with a body, numbered without gaps."""
    placed = F.filter(F.transform("executables", lambda e, i: F.when(_concrete(e), i)), lambda i: i.isNotNull())
    rows = types.select("repo", "tpos", "method_base", "body_base", F.posexplode(placed).alias("bpos", "epos"))
    number = F.col("body_base") + F.col("bpos")
    return rows.select(
        "repo", _atom("ImplementationBinding", number).alias("binding"), _atom("Classifier", "tpos").alias("implementer"),
        _atom("Method", F.col("method_base") + F.col("epos")).alias("target"), _atom("MethodBody", number).alias("body"),
    )


def local_methods(types: DataFrame) -> DataFrame:
    """Tuples (repo, src, dst) of classes and their methods."""
    return methods(types).select("repo", F.col("cls").alias("src"), F.col("method").alias("dst"))


def local_attributes(types: DataFrame) -> DataFrame:
    return attributes(types).select("repo", F.col("cls").alias("src"), F.col("attribute").alias("dst"))


def signatures(types: DataFrame) -> DataFrame:
    """(repo, qualified_name, signature) of each executable: its name and parameter types."""
    rows = types.select("repo", "qualifiedName", F.explode("executables").alias("e"))
    of = param_signature(F.transform("e.parameters", lambda p: p["type"]))
    return rows.select("repo", F.col("qualifiedName").alias("qualified_name"), F.concat("e.name", F.lit("("), of, F.lit(")")).alias("signature"))


def in_order(documents: DataFrame) -> DataFrame:
    """(repo, pos, qualifiedName, fields, executables, interfaces): types by name and source file, those without a file
    first; their fields by name, executables by name and parameter types, interfaces by name.

    Types are sorted among those of their name; only names with their numbers are counted through a repository. Documents
    are read once, when this is called.
    """
    signature = lambda e: F.concat(e["name"], F.lit("("), param_signature(F.transform(e["parameters"], lambda p: p["type"])), F.lit(")"))
    t = _parsed(documents).select("repo", F.explode("d.types").alias("t"))
    rows = written(t.select(
        "repo", "t.qualifiedName", F.coalesce("t.sourceFile", F.lit("")).alias("file"), F.array_sort(F.transform("t.fields", lambda f: f["name"])).alias("fields"),
        F.array_sort(F.transform("t.executables", signature)).alias("executables"), F.array_sort("t.interfaces").alias("interfaces"),
    ), "types")
    n = rows.groupBy("repo", "qualifiedName").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("repo").orderBy("qualifiedName").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col("repo").alias("of"), F.col("qualifiedName").alias("named"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("repo", "qualifiedName").orderBy("file", "fields", "executables", "interfaces")) - 1
    placed = rows.withColumn("within", within).join(n, (F.col("repo") == F.col("of")) & F.col("qualifiedName").eqNullSafe(F.col("named")))
    return placed.select("repo", (F.col("before") + F.col("within")).cast("int").alias("pos"), "qualifiedName", "fields", "executables", "interfaces")


def to_documents(types: DataFrame, version: str = "1.0", size: int | None = None) -> DataFrame:
    """One JSON document (repo, value) for each repository of `types` (repo, tpos and the fields of TYPE).
    With `size`, documents in parts (repo, part, value) of that many types, see `load_types`."""
    fields = [c for c in types.columns if c not in ("repo", "tpos", "method_base", "field_base", "body_base")]
    by = ["repo"] + ([F.floor(F.col("tpos") / size).alias("part")] if size else [])
    each = types.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tpos", F.struct(*fields).alias("t")))).alias("all"))
    return each.select(*keys(each), F.to_json(F.struct(F.lit(version).alias("schemaVersion"), F.transform("all", lambda x: x["t"]).alias("types"))).alias("value"))
